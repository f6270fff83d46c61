"""Chat formatting with typed content parts, by DataFrame functions only.

A formatted conversation is a row of turns,

    <|turn|>role<|body|>content<|end|>

whose content is the turn's parts in order.  Text parts stand as they are, with ``<|`` written ``<||``: control strings
have a letter after ``<|``, so no text can hold one, and taking one bar from each ``<||`` gives the text back.  Between two
text parts stands ``<|text|>``, so their ends form no control string together and they stay apart.  An image, audio or
document part is a placeholder ``<|image:i|>``, where i is its place in the conversation's list of attachments; that list
has its reference and the number of tokens that it will take.  A part whose type is null or not among these is a placeholder
``<|unknown:i|>``: its attachment keeps the type, and takes no token.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END, TEXT, UNKNOWN = "<|turn|>", "<|body|>", "<|end|>", "<|text|>", "unknown"
#: Fields of a part; those that its type does not use are null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that a part of each type takes, apart from text: image patches of 14 by 14 pixels, 25 audio frames a second, 512
#: tokens a page; a missing size counts as one patch, frame or page.
EXPANSION: dict[str, Callable[[Column], Column]] = {
    "image": lambda p: F.greatest(F.lit(1), F.ceil(F.coalesce(p["width"], F.lit(1)) / 14) * F.ceil(F.coalesce(p["height"], F.lit(1)) / 14)),
    "audio": lambda p: F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25)),
    "document": lambda p: F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(1))) * 512,
}


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def text_part(text: Column | str) -> Column:
    """A content of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    null = lambda kind: F.lit(None).cast(kind)
    fields = F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")
    return F.array(F.struct(*fields))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(False))


def _visit(part: Column, number: Column, after_text: Column, expansion: dict) -> Column:
    """What a part leaves in the content."""
    named = F.when(part["type"].isin(*expansion), part["type"]).otherwise(UNKNOWN)
    return F.when(_is_text(part), F.concat(F.when(after_text, TEXT).otherwise(""), escape(part["text"]))).otherwise(F.concat(F.lit("<|"), named, F.lit(":"), number.cast("string"), F.lit("|>")))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), expansion: dict | None = None) -> DataFrame:
    """One row per conversation of ``messages(conv_id, turn, role, parts)``.

    ``formatted`` is its text; ``loss`` has the spans (code points: start, length) of the contents of ``loss_roles``;
    ``attachments`` the other parts (type, ref, tokens) in order; ``attached_tokens`` their tokens in all.  Turns go by
    ``turn``, then role, then content (repeated rows each count); a null role is empty; null parts, empty and null texts and
    null contents leave nothing.  Rows without ``conv_id`` are left out, other columns are not read, and no rows give none.  A
    conversation is one row, so it has to fit a task's memory, however long its texts are.
    """
    expansion = EXPANSION if expansion is None else expansion
    if not all(re.fullmatch("[a-z]{1,20}", kind) and kind not in ("turn", "body", "end", "text", UNKNOWN) for kind in expansion):
        raise ValueError("the name of a type of part has up to 20 letters a-z and is no name of a control string")
    is_other = lambda p: ~_is_text(p)
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull() & (is_other(p) | (F.length(p["text"]) > 0)))
    rows = messages.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("others", F.size(F.filter("parts", is_other)))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json(F.struct("parts")))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seq", F.row_number().over(in_order)).withColumn("number", F.coalesce(F.sum("others").over(before), F.lit(0)))
    nth = lambda i: F.col("number") + F.size(F.filter(F.slice("parts", 1, i), is_other))
    after_text = lambda i: (i > 0) & _is_text(F.get("parts", i - 1))
    body = F.array_join(F.transform("parts", lambda p, i: _visit(p, F.when(F.col("others") > 0, nth(i)).otherwise(F.lit(0)), after_text(i), expansion)), "")
    tokens = lambda p: F.coalesce(*(F.when(p["type"] == kind, f(p).cast("long")) for kind, f in expansion.items()), F.lit(0).cast("long"))
    attached = F.transform(F.filter("parts", is_other), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    rows = rows.select("conv_id", "seq", "role", body.alias("body"), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"), attached.alias("attached"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    by_seq = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(by_seq), F.lit(0)) + F.length("head")
    rows = rows.withColumn("span", F.when(F.col("role").isin(*loss_roles), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", "span", "attached"))).alias("turns"))
    out = turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    )
    return out.withColumn("attached_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _parts(content: Column) -> Column:
    """The parts of a content: ``type, text, number``; a control string is ``<|`` before a letter, which no text has."""
    piece = "struct<type:string,text:string,number:int>"
    pieces = F.split(content, r"<\|(?=[a-z])")
    control = lambda p: F.substring_index(p, "|>", 1)
    rest = lambda p: F.substring(p, F.length(control(p)) + 3, F.length(p))
    text = lambda t: F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), F.lit(None).cast("int").alias("number")).cast(piece)
    other = lambda c: F.struct(F.substring_index(c, ":", 1).alias("type"), F.lit(None).cast("string").alias("text"), F.substring_index(c, ":", -1).cast("int").alias("number")).cast(piece)
    told = lambda t: F.when(F.length(t) > 0, text(t))
    return F.array_compact(F.flatten(F.transform(pieces, lambda p, i: F.when(i == 0, F.array(told(p))).otherwise(F.array(F.when(control(p) != "text", other(control(p))), told(rest(p)))))))


def _texts(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def read_chats(formatted: DataFrame) -> DataFrame:
    """What ``format_chats`` was given, read back from its output alone.

    ``turns`` has each turn's role, its text parts joined as ``text``, and its ``parts`` (type, text, ref, tokens), without
    those that left nothing; ``loss_text`` is all text under the loss mask.
    """
    turns = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2_000_000_000)
    role = lambda t: F.substring_index(t, BODY, 1)
    content = lambda t: F.substring(t, F.length(role(t)) + len(BODY) + 1, F.length(t) - F.length(role(t)) - len(BODY) - len(END))
    kind = lambda p: F.when(p["type"] == UNKNOWN, F.get("attachments", p["number"])["type"]).otherwise(p["type"])
    whole = lambda p: F.struct(kind(p).alias("type"), p["text"].alias("text"), F.get("attachments", p["number"])["ref"].alias("ref"), F.get("attachments", p["number"])["tokens"].alias("tokens"))
    turn = lambda t: F.struct(unescape(role(t)).alias("role"), _texts(_parts(content(t))).alias("text"), F.transform(_parts(content(t)), whole).alias("parts"))
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(turns, turn).alias("turns"),
        F.array_join(F.transform("loss", lambda s: _texts(_parts(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))), "").alias("loss_text"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_chats`` returns."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
