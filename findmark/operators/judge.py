"""Requests to a judge, its replies, and their validation, as tables.

A judge is a user's function, a table of recorded replies, or the rules of ``functions.rules``.  Replies are costly and may
differ from run to run, so callers store what ``call_judge`` returns before they use it twice.  Bad replies are rows with a
reason, never exceptions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmark.functions import normalize as N
from findmark.sources.scratch import stored, stored_by_series

MESSAGES = "array<struct<role:string,content:string>>"
USAGE = "struct<model:string,uncached_input:bigint,cache_read:bigint,cache_write:bigint,output:bigint>"
CHUNK, MOST_ATTEMPTS, MOST_RETRIES = 10, 5, 3


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def extraction_requests(reports: DataFrame, indications: DataFrame, system: str, prefix: list[tuple[str, str]] | None = None) -> DataFrame:
    """System message, few-shot prefix and the report, under its indication where there is one."""
    block = F.when(F.length("indication") > 0, F.concat(F.lit("Study indication: "), "indication", F.lit("\n\n"))).otherwise("")
    shots = [message(r, F.lit(c)) for r, c in prefix or []]
    joined = reports.join(indications.select("series_uuid", "indication"), "series_uuid", "left").withColumn("indication", F.coalesce("indication", F.lit("")))
    return joined.select("series_uuid", "side", F.array(message("system", F.lit(system)), *shots, message("user", F.concat(block, "text"))).alias("messages"))


def indication_requests(reports: DataFrame, system: str) -> DataFrame:
    return reports.select("series_uuid", F.array(message("system", F.lit(system)), message("user", F.col("text"))).alias("messages"))


def finding_lists(findings: DataFrame, both: bool = False) -> DataFrame:
    """``series_uuid, pred_findings, gt_findings``: the fields that matching sees, in order; a missing side is empty.

    With ``both`` only series with findings on both sides have a row: those that matching asks about.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "finding_id", "text", "clinical_status", "laterality"))), lambda f: f.dropFields("pos"))
    # each side by itself: rows of a table by series stay in place, which a union of both sides would not let them
    pred, gt = (findings.where(F.col("side") == s).groupBy("series_uuid").agg(listed.alias(f"{s}_findings")) for s in ("pred", "gt"))
    none = F.array().cast("array<struct<finding_id:string,text:string,clinical_status:string,laterality:string>>")
    if both:
        return pred.join(gt, "series_uuid")
    return pred.join(gt, "series_uuid", "full").select("series_uuid", *(F.coalesce(f"{s}_findings", none).alias(f"{s}_findings") for s in ("pred", "gt")))


def matching_requests(lists: DataFrame, indications: DataFrame, system: str, errors: DataFrame | None = None) -> DataFrame:
    """One request per series with findings on both sides; a retry names the errors of the reply before."""
    rows = lists.where("size(pred_findings) > 0 AND size(gt_findings) > 0").join(indications.select("series_uuid", "indication"), "series_uuid", "left")
    payload = F.to_json(F.struct(F.when(F.length("indication") > 0, F.col("indication")).alias("indication"), "pred_findings", "gt_findings"))
    if errors is not None:
        rows = rows.join(errors.select("series_uuid", "errors"), "series_uuid", "left")
        wrong = F.when(F.size("errors") > 0, F.concat(F.lit("Your last answer was not valid:\n- "), F.array_join("errors", "\n- "), F.lit("\n\n"))).otherwise("")
        payload = F.concat(wrong, payload)
    return rows.select("series_uuid", F.array(message("system", F.lit(system)), message("user", payload)).alias("messages"))


def trivial_matches(lists: DataFrame) -> DataFrame:
    """Series with an empty side: no request, everything is unmatched."""
    ids = lambda s: F.transform(f"{s}_findings", lambda f: f["finding_id"]).alias(f"unmatched_{s}")
    return lists.where("size(pred_findings) = 0 OR size(gt_findings) = 0").select("series_uuid", ids("pred"), ids("gt"))


def attribute_chunks(pairs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Pairs to be judged, ``pairs(series_uuid, match_idx, needs_judge, …)``, in chunks and numbered from one in each."""
    n = F.row_number().over(Window.partitionBy("series_uuid").orderBy("match_idx")) - 1
    return pairs.where("needs_judge").withColumn("n", n).withColumn("chunk", F.floor(F.col("n") / size).cast("int")).withColumn("pair_id", (F.col("n") % size + 1).cast("int")).drop("n")


def attribute_requests(chunks: DataFrame, system: str, indications: DataFrame | None = None, correct: bool = False) -> DataFrame:
    """One request per chunk (and part) of ``chunks(…, pair_id, pred_id, gt_id, p_text, g_text, same_group_pred,
    same_group_gt)``: the study's indication, where there is one, and the pairs; absent context has no key.

    ``asked`` names the pairs by their number.  With ``correct`` the request says what was wrong with the answer before.
    """
    keys = [k for k in ("series_uuid", "chunk", "part") if k in chunks.columns]
    pair = F.struct("pair_id", F.col("p_text").alias("pred"), F.col("g_text").alias("gt"), "same_group_pred", "same_group_gt")
    # counted apart from the lists, which are then not made where only the number is read
    rows = chunks.groupBy(*keys).agg(F.count("*").cast("int").alias("n_pairs"), F.array_sort(F.collect_list(pair)).alias("pairs"), F.array_sort(F.collect_list(F.struct("pair_id", "pred_id", "gt_id"))).alias("asked"))
    if indications is None:
        rows = rows.withColumn("indication", F.lit(None).cast("string"))
    else:
        rows = rows.join(indications.select("series_uuid", F.when(F.length("indication") > 0, F.col("indication")).alias("indication")), "series_uuid", "left")
    messages = [message("system", F.lit(system)), message("user", F.to_json(F.struct("indication", "pairs")))]
    if correct:
        messages.append(message("user", F.concat(F.lit("Your last answer was not valid: errors_per_pair must have one entry for each pair_id from 1 to "), F.size("pairs").cast("string"), F.lit("."))))
    return rows.select(*keys, "n_pairs", "asked", F.array(*messages).alias("messages"))


def call_judge(requests: DataFrame, judge: Callable[[list[dict]], str | tuple[str, dict]], keys: list[str], attempts: int = MOST_ATTEMPTS, tasks: int | None = None, retryable: tuple[type[BaseException], ...] = (Exception,), own_timeout: bool = False, threads: int = 1) -> DataFrame:
    """Replies of ``judge(messages)`` to ``requests(<keys>, messages)``: ``<keys>, reply, error, attempts, usage``.

    The judge returns its text, or the text and a dict of the fields of ``USAGE``, which ``metrics.token_cost`` sums up; an
    exception may carry such a dict as ``usage``.  The usage of a row is that of all its attempts, failed ones too.  A
    ``retryable`` exception or an empty reply is tried again; any other exception is not, and a ``TimeoutError`` is not
    where the judge has a timeout of its own (``own_timeout``).  What fails to the end is a row with its error.  A task has
    ``threads`` calls open at a time, so a slow one does not hold up the others.
    """
    kinds = dict(requests.dtypes)

    def summed(usage: dict | None, more: dict | None) -> dict | None:
        if not more:
            return usage
        counts = ("uncached_input", "cache_read", "cache_write", "output")
        return {"model": more.get("model") or (usage or {}).get("model")} | {c: ((usage or {}).get(c) or 0) + (more.get(c) or 0) for c in counts}

    def one(messages) -> tuple:
        said, error, n, usage = None, None, 0, None
        while not said and n < attempts:
            n += 1
            try:
                said, error = judge([dict(m) if isinstance(m, dict) else m.asDict() for m in messages]), None
                if isinstance(said, tuple):
                    said, own = said
                    usage = summed(usage, own)
            except Exception as e:  # a user's function may raise anything
                usage = summed(usage, getattr(e, "usage", None))
                said, error = None, f"{type(e).__name__}: {e}"
                if not isinstance(e, retryable) or (own_timeout and isinstance(e, TimeoutError)):
                    break
        return said or None, None if said else error or "empty reply", n, usage

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                out = frame[keys].copy()
                replies = list(pool.map(one, frame["messages"]))
                out["reply"], out["error"], out["attempts"], out["usage"] = zip(*replies) if replies else ([], [], [], [])
                yield out

    rows = requests.repartition(tasks) if tasks else requests
    return rows.select(*keys, "messages").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "reply string", "error string", "attempts int", f"usage {USAGE}"]))


def recorded_replies(requests: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Replies from a table; a request without one has an error."""
    out = requests.select(*keys).join(replies.select(*keys, "reply"), keys, "left")
    return out.withColumn("error", F.when(F.col("reply").isNull(), "no recorded reply")).withColumn("attempts", F.lit(1))


# Replies


def _is(v: Column, kind: str) -> Column:
    """Whether a value is a scalar of the type."""
    return F.schema_of_variant(v) == kind


def _list(v: Column | str, path: str = "$") -> Column:
    """The items of a list, null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _opens_object(reply: str) -> Column:
    """Whether a reply that can be parsed is an object as a whole; told by its first letter, so nothing is copied."""
    return F.col(reply).rlike(r"^[ \t\n\r]*\{")


def read_findings(replies: DataFrame) -> DataFrame:
    """``replies(series_uuid, side, reply)``, each read once: a row per finding, and for bad JSON or a missing list of findings a
    row with its ``reason`` and ``raw_response``; ``split_findings`` tells them apart."""
    parsed = replies.withColumn("v", F.try_parse_json("reply")).withColumn("list", _list("v", "$.findings"))
    bad = F.col("list").isNull()
    parsed = parsed.withColumn("reason", F.when(bad, F.when(F.col("v").isNull(), "not JSON").otherwise("no list of findings"))).withColumn("raw_response", F.when(bad, F.col("reply")))
    slots = parsed.select("series_uuid", "side", "reason", "raw_response", F.posexplode_outer("list").alias("pos", "f")).where(F.col("reason").isNotNull() | _is_object(F.col("f")))
    get = lambda c: F.try_variant_get("f", f"$.{c}", "string")
    items = _list("f", "$.measurements")
    return slots.select(
        "series_uuid", "side", "reason", "raw_response", "pos", N.finding_id("series_uuid", "pos").alias("finding_id"), F.coalesce(get("text"), F.lit("")).alias("text"),
        N.status(get("clinical_status")).alias("clinical_status"), N.significance(get("clinical_significance")).alias("clinical_significance"),
        N.laterality(get("laterality")).alias("laterality"), N.comparison(get("comparison")).alias("comparison"), N.measurements(items).alias("measurements"),
    )


def split_findings(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and failures of ``read_findings``."""
    return read.where("reason is null").drop("reason", "raw_response"), read.where("reason is not null").select("series_uuid", "side", "reason", "raw_response")


def parse_findings(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``replies(series_uuid, side, reply)`` to findings, and to failures for bad JSON or a missing list of findings."""
    return split_findings(read_findings(replies))


def parse_indications(replies: DataFrame) -> DataFrame:
    """Bad JSON gives no row; what is not an object with a string gives the empty string."""
    v = F.try_variant_get("v", "$.indication", "variant")
    return replies.withColumn("v", F.try_parse_json("reply")).where("v IS NOT NULL").select("series_uuid", F.coalesce(F.when(_is(v, "STRING"), F.trim(F.try_variant_get("v", "$.indication", "string"))), F.lit("")).alias("indication"))


def validate_matching(replies: DataFrame) -> DataFrame:
    """``replies(series_uuid, reply, pred_ids, gt_ids)`` with typed lists and ``errors``, every broken rule of the reply."""
    none, strings = F.array().cast("array<variant>"), F.array().cast("array<string>")
    rows = replies.withColumn("v", F.try_parse_json("reply"))
    bad_lists = []
    for key in ("matches", "unmatched_pred", "unmatched_gt"):
        given, items = F.try_variant_get("v", f"$.{key}", "variant"), _list("v", f"$.{key}")
        rows = rows.withColumn(key, F.coalesce(items, none))
        bad_lists.append(F.when(given.isNotNull() & items.isNull(), F.lit(f"{key} must be a list")))
    text = lambda x, path="$": F.when(_is(F.try_variant_get(x, path, "variant"), "STRING"), F.try_variant_get(x, path, "string"))
    rows = rows.withColumn("pairs", F.transform(F.filter("matches", _is_object), lambda m: F.struct(text(m, "$.pred_id").alias("pred_id"), text(m, "$.gt_id").alias("gt_id"), F.coalesce(text(m, "$.reasoning"), F.lit("")).alias("reasoning"))))
    say = lambda array, what: F.transform(array, lambda x: F.concat(F.lit(what), F.coalesce(x.cast("string"), F.lit("?"))))
    # equal values lie side by side in order; names go in order of their first place
    side_by_side = lambda a: F.element_at(F.transform(F.array(F.array_sort(a)), lambda t: F.filter(t, lambda x, i: (i > 0) & (x == F.get(t, i - 1)))), 1)
    twice = lambda a: F.array_intersect(F.array_distinct(a), side_by_side(a))
    full = F.transform(F.filter("pairs", lambda m: m["pred_id"].isNotNull() & m["gt_id"].isNotNull()), lambda m: F.concat_ws(" - ", m["pred_id"], m["gt_id"]))
    errors = [
        F.array_compact(F.array(*bad_lists)),
        say(F.filter("matches", lambda m: ~_is_object(m)), "not an object in matches: "),
        F.flatten(F.transform("pairs", lambda m: F.array_compact(F.array(F.when(m["pred_id"].isNull(), "a pred_id is not a string"), F.when(m["gt_id"].isNull(), "a gt_id is not a string"))))),
        say(twice(full), "repeated pair: "),
    ]
    # most replies break no rule, and that is told by a few comparisons
    right = (F.size(F.array_compact(F.array(*bad_lists))) == 0) & (F.size("pairs") == F.size("matches")) & (F.size(full) == F.size("pairs")) & (F.size(F.array_distinct(full)) == F.size(full))
    for side in ("pred", "gt"):
        rows = rows.withColumn(f"free_{side}", F.transform(f"unmatched_{side}", lambda x: text(x))).withColumn(f"in_{side}", F.array_compact(F.array_distinct(F.transform("pairs", lambda m: m[f"{side}_id"]))))
        free = F.array_compact(f"free_{side}")
        named, ids = F.array_union(F.col(f"in_{side}"), free), F.coalesce(F.col(f"{side}_ids"), strings)
        # every id once, matched or not, and no other
        both = F.concat(F.col(f"in_{side}"), free)
        right &= (F.size(free) == F.size(f"free_{side}")) & (F.size(both) == F.size(F.array_distinct(both))) & (F.sort_array(both) == F.sort_array(F.array_distinct(ids)))
        errors += [
            F.transform(F.filter(f"free_{side}", lambda x: x.isNull()), lambda _: F.lit(f"an id in unmatched_{side} is not a string")),
            say(twice(free), f"twice in unmatched_{side}: "),
            say(F.array_intersect(F.col(f"in_{side}"), free), f"matched and in unmatched_{side}: "),
            say(F.array_except(named, ids), f"unknown {side} id: "),
            say(F.array_except(ids, named), f"missing {side} id: "),
        ]
    is_object = F.col("v").isNotNull() & _opens_object("reply")
    no_error = F.array().cast("array<string>")
    return rows.withColumn("errors", F.when(is_object & F.coalesce(right, F.lit(False)), no_error).when(is_object, F.concat(*errors)).otherwise(F.array(F.lit("the answer is not a JSON object")))).select("series_uuid", "reply", "pred_ids", "gt_ids", "pairs", F.array_compact("free_pred").alias("unmatched_pred"), F.array_compact("free_gt").alias("unmatched_gt"), is_object.alias("parsed"), "errors")


def in_input_order(matches: DataFrame, pred: DataFrame) -> DataFrame:
    """``matches(series_uuid, reply_pos, pred_id, gt_id)`` with ``match_idx``: by the candidate's position, unknown ones last."""
    order = pred.select("series_uuid", F.col("finding_id").alias("pred_id"), F.col("pos").alias("pred_pos"))
    w = Window.partitionBy("series_uuid").orderBy(F.col("pred_pos").asc_nulls_last(), "reply_pos")
    return matches.join(order, ["series_uuid", "pred_id"], "left").withColumn("match_idx", F.row_number().over(w) - 1).drop("pred_pos")


def fallback(validated: DataFrame) -> DataFrame:
    """The last parseable reply's valid pairs, each once, for series whose attempts are spent; the rest is unmatched."""
    ok = F.array_distinct(F.filter(F.transform("pairs", lambda m: F.struct(m["pred_id"].alias("pred_id"), m["gt_id"].alias("gt_id"))), lambda m: F.array_contains("pred_ids", m["pred_id"]) & F.array_contains("gt_ids", m["gt_id"])))
    place = lambda m: F.struct(F.array_position("pred_ids", m["pred_id"]).alias("at"), m["pred_id"].alias("pred_id"), m["gt_id"].alias("gt_id"))
    rows = validated.withColumn("ok", F.transform(F.array_sort(F.transform(F.coalesce(ok, F.array().cast("array<struct<pred_id:string,gt_id:string>>")), place)), lambda m: m.dropFields("at")))
    rest = lambda s: F.sort_array(F.array_except(f"{s}_ids", F.transform("ok", lambda m: m[f"{s}_id"]))).alias(f"unmatched_{s}")
    return rows.select("series_uuid", F.col("ok").alias("pairs"), rest("pred"), rest("gt"), F.lit(True).alias("validation_fallback"))


def match_with_retries(lists: DataFrame, indications: DataFrame, system: str, ask: Callable[[DataFrame, int], DataFrame], retries: int = 2) -> DataFrame:
    """Asks for matches, and again for those series whose reply was not valid, up to ``retries`` more times.

    ``ask(requests, attempt)`` returns ``series_uuid, reply``.  Returns ``pairs, unmatched_pred, unmatched_gt,
    validation_fallback, retries`` per series with findings on both sides.
    """
    ids = lambda s: F.transform(f"{s}_findings", lambda f: f["finding_id"]).alias(f"{s}_ids")
    open_series = lists.where("size(pred_findings) > 0 AND size(gt_findings) > 0")
    open_series = open_series if hasattr(lists, "_stored_at") else stored_by_series(open_series, "open")
    errors, last, out = None, None, []
    for attempt in range(retries + 1):
        replies = ask(matching_requests(open_series, indications, system, errors), attempt)
        told = open_series.select("series_uuid", ids("pred"), ids("gt")).join(replies.select("series_uuid", "reply"), "series_uuid", "left")
        checked = stored_by_series(validate_matching(told).drop("reply"), "checked")
        good = checked.where("size(errors) = 0")
        out.append(good.select("series_uuid", F.transform("pairs", lambda m: m.dropFields("reasoning")).alias("pairs"), "unmatched_pred", "unmatched_gt", F.lit(False).alias("validation_fallback"), F.lit(attempt).alias("retries")))
        bad = checked.where("size(errors) > 0")
        if bad.isEmpty():
            last = None
            break
        # the last reply that could be parsed is kept for each series that stays open
        new = bad.select("series_uuid", "pred_ids", "gt_ids", "parsed", F.when(F.col("parsed"), F.col("pairs")).alias("pairs"))
        if last is not None:
            new = new.join(last.select("series_uuid", F.col("pairs").alias("older")), "series_uuid", "left").withColumn("pairs", F.coalesce("pairs", "older")).drop("older")
        last = stored_by_series(new, "last")
        errors = bad.select("series_uuid", "errors")
        if attempt < retries and not good.isEmpty():  # else all stay open
            open_series = stored_by_series(open_series.join(bad.select("series_uuid"), "series_uuid", "left_semi"), "open")
    if last is not None:
        out.append(fallback(last).withColumn("retries", F.lit(retries)))
    return reduce(DataFrame.unionByName, out)


def alias_ids(findings: DataFrame) -> DataFrame:
    """Findings with ``alias``: short ids by position (``p_1``, ``gt_1``); a side with a repeated id keeps its own."""
    w = Window.partitionBy("series_uuid", "side")
    short = F.concat(F.when(F.col("side") == "pred", "p_").otherwise("gt_"), F.row_number().over(w.orderBy("pos")).cast("string"))
    unique = F.size(F.collect_set("finding_id").over(w)) == F.count("*").over(w)
    return findings.withColumn("alias", F.when(unique, short).otherwise(F.col("finding_id")))


def parse_attribute_replies(replies: DataFrame) -> DataFrame:
    """``replies(series_uuid, chunk, n_pairs, reply)`` with ``ok`` and ``answers`` (pair_id, errors), placed by id.

    A reply counts if it is an object whose ``errors_per_pair`` has the ids from one to ``n_pairs``, true integers, once
    each, with lists of errors.
    """
    rows = replies.withColumn("v", F.try_parse_json("reply"))
    rows = rows.withColumn("items", _list("v", "$.errors_per_pair"))
    shaped = F.forall("items", lambda i: F.coalesce(_is_object(i) & _is(F.try_variant_get(i, "$.pair_id", "variant"), "BIGINT") & _list(i, "$.errors").isNotNull(), F.lit(False)))
    ids = F.sort_array(F.transform("items", lambda i: F.try_variant_get(i, "$.pair_id", "int")))
    wanted = F.when(F.col("n_pairs") > 0, F.sequence(F.lit(1), F.col("n_pairs").cast("int"))).otherwise(F.array().cast("array<int>"))
    get = lambda e, c: F.try_variant_get(e, f"$.{c}", "string")
    errors = lambda i: N.judge_errors(F.transform(F.filter(_list(i, "$.errors"), _is_object), lambda e: F.struct(get(e, "dimension").alias("dimension"), get(e, "severity").alias("severity"), get(e, "reasoning").alias("reasoning"))))
    rows = rows.withColumn("ok", F.coalesce(shaped & (ids == wanted), F.lit(False)))
    answers = F.when(F.col("ok"), F.transform("items", lambda i: F.struct(F.try_variant_get(i, "$.pair_id", "int").alias("pair_id"), errors(i).alias("errors"))))
    return rows.withColumn("answers", answers).drop("v", "items")


def judge_with_splits(chunks: DataFrame, ask: Callable[[DataFrame, int], DataFrame], retries: int = MOST_RETRIES, system: str = "", indications: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Judges ``chunks(series_uuid, chunk, pair_id, …)``; a chunk whose retries are spent is halved, down to single pairs.

    ``ask(requests, attempt)`` answers ``attribute_requests`` of the chunks (and parts) that are left and returns
    ``series_uuid, chunk, part, reply``; from the second attempt on requests carry a correction.  Returns
    ``answers(series_uuid, pred_id, gt_id, errors)`` and failures of single pairs: each pair is in one of the two.
    """
    keys = ["series_uuid", "chunk", "part"]
    left = stored_by_series(chunks.withColumn("part", F.lit("")), "chunks")
    none = left.select("series_uuid", "pred_id", "gt_id", F.lit("").alias("reason")).where("false")
    answers, failures = [], [none]
    while True:  # each round halves what is left, so it ends when the largest chunk is down to single pairs
        for attempt in range(retries + 1):
            requests = attribute_requests(left, system, indications, attempt > 0)
            replies = ask(requests, attempt).select(*keys, "reply")
            parsed = stored_by_series(parse_attribute_replies(requests.select(*keys, "n_pairs").join(replies, keys, "left")).drop("reply"), "parsed")
            found = parsed.where("ok").select(*keys, F.explode("answers").alias("a")).select(*keys, "a.pair_id", "a.errors")
            answers.append(left.join(found, [*keys, "pair_id"]).select("series_uuid", "pred_id", "gt_id", "errors"))
            if parsed.where("NOT ok").isEmpty():
                return reduce(DataFrame.unionByName, answers), reduce(DataFrame.unionByName, failures)
            if not parsed.where("ok").isEmpty():  # else all are left
                left = stored_by_series(left.join(parsed.where("NOT ok").select(*keys), keys, "left_semi"), "left")
        n = F.count("*").over(Window.partitionBy(*keys))
        failures.append(left.withColumn("n", n).where("n = 1").select("series_uuid", "pred_id", "gt_id", F.lit("no valid answer for one pair").alias("reason")))
        first = F.floor(F.col("n") / 2)
        halves = left.withColumn("n", n).where("n > 1").withColumn("part", F.concat("part", F.when(F.col("pair_id") <= first, "a").otherwise("b"))).withColumn("pair_id", F.when(F.col("pair_id") <= first, F.col("pair_id")).otherwise(F.col("pair_id") - first).cast("int")).drop("n")
        left = stored_by_series(halves, "halves")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, answers), reduce(DataFrame.unionByName, failures)


def scatter(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Every pair with its answer's errors; a pair that was not judged has none."""
    none = F.array().cast("array<struct<dimension:string,severity:string,reasoning:string>>")
    return pairs.join(answers, ["series_uuid", "pred_id", "gt_id"], "left").withColumn("errors", F.coalesce("errors", none))
