"""Quality rules, with the frequency of lines across the documents of a host.

One pass over the texts gives each document's counts and, for each distinct normalised line, its hash and words.  A line
that stands in more documents of its host than the limit is boilerplate and is removed; a document that loses more than
half of its words by that is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmark.llm.shared import stored

#: A line is boilerplate in more than this many documents of its host, and more than this share of them.
LINE_DOCS, LINE_SHARE = 20, 0.1
#: Base rules: words at least, and repeated words per hundred at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text; null has none of all."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lost = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        m = len(number)
        two = ids[:-1] * m + ids[1:]
        if m > 2_000_000:
            two = np.unique(two, return_inverse=True)[1]
        three = two[:-1] * m + ids[2:]
        order = np.argsort(three, kind="stable")
        same = np.diff(three[order]) == 0
        twice = np.zeros(n - 2, bool)
        twice[order[:-1][same]] = twice[order[1:][same]] = True
        inside = np.zeros(n, bool)
        inside[:-2] |= twice
        inside[1:-1] |= twice
        inside[2:] |= twice
        repeated = int(inside.sum())
    return n, len(text) - lost(_SPACE), lost(_SYMBOLS), len(lines) - len(set(lines)), repeated


def line_hashes(text: str | None) -> dict[int, int]:
    """For each distinct line with a word, lower-cased and with single blanks: its hash, and the words of all its copies."""
    from xxhash import xxh64_intdigest

    out: dict[int, int] = {}
    for line in (text or "").lower().split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if words:
            h = xxh64_intdigest(b" ".join(words)) - (1 << 63)
            out[h] = out.get(h, 0) + len(words)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for b in batches:
        texts = b.column(3).to_pylist()
        counts = np.array([measure(t) for t in texts], np.int64).reshape(-1, 5)
        lines = [line_hashes(t) for t in texts]
        hashes, words = pa.array([list(x) for x in lines], pa.list_(pa.int64())), pa.array([list(x.values()) for x in lines], pa.list_(pa.int32()))
        yield pa.record_batch([*b.columns[:3], *(pa.array(c.copy()) for c in counts.T), hashes, words], ["row", "doc_id", "host", *names, "hashes", "line_words"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [line_hashes(t) for t in b.column(2).to_pylist()]
        hashes, words = pa.array([list(x) for x in lines], pa.list_(pa.int64())), pa.array([list(x.values()) for x in lines], pa.list_(pa.int32()))
        yield pa.record_batch([*b.columns[:2], hashes, words], ["row", "host", "hashes", "line_words"])


def _often(rows: DataFrame, line_docs: int, line_share: float) -> tuple[DataFrame, DataFrame]:
    """Lines ``row, host, h, w`` of measured ``rows``, and the boilerplate ``host, h`` among them."""
    lines = rows.select("row", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("l")).select("row", "host", F.col("l.hashes").alias("h"), F.col("l.line_words").alias("w"))
    often = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    return lines, stored(often.join(hosts, "host").where(F.col("n") > F.col("host_docs") * F.lit(line_share)).select("host", "h"), "boilerplate")


def without_lines(text: str | None, hashes: set[int]) -> str | None:
    """``text`` without the lines whose normalised form has one of ``hashes``."""
    from xxhash import xxh64_intdigest

    if text is None or not hashes:
        return text
    hashed = lambda line: xxh64_intdigest(b" ".join(line.encode("utf-8", "surrogatepass").split())) - (1 << 63)
    return "\n".join(x for x, low in zip(text.split("\n"), text.lower().split("\n"), strict=True) if not low.strip() or hashed(low) not in hashes)


def apply_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Counts and verdicts for every row of ``docs(doc_id, text, <host>)``.

    Rows that share an id each give a row; a null host is a host of its own, named by the empty string; a null text has no
    words and fails the base rules.  ``removed_words`` are those of the boilerplate lines that ``remove_lines`` takes out.  A
    text of any length is measured whole; other columns are not read; an empty table gives no row.
    """
    schema = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, line_words array<int>"
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    rows = stored(own.mapInArrow(_rows, schema), "line-rules")
    lines, often = _often(rows, line_docs, line_share)
    removed = lines.join(often, ["host", "h"]).groupBy("row").agg(F.sum("w").cast("long").alias("removed_words"))
    out = rows.drop("hashes", "line_words").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (2 * F.col("removed_words") <= F.col("n_words"))).alias("kept"), "removed_words",
    )


def remove_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, chars: str | None = "n_chars") -> DataFrame:
    """Every row of ``docs``, all columns, with its text without boilerplate lines.

    The words that go are the ``removed_words`` of ``apply_rules``.  ``chars``, where it is one, is the new length.
    """
    names, schema = docs.columns, docs.schema
    # the rows are kept with their numbers, so the lines found come back to the row they are from
    own = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(docs[c] for c in names)).alias("doc")), "numbered")
    lines = own.select("row", F.coalesce(F.col(f"doc.{host}").cast("string"), F.lit("")).alias("host"), F.col("doc.text").alias("text")).mapInArrow(_lines, "row long, host string, hashes array<long>, line_words array<int>")
    lines, often = _often(stored(lines, "lines"), line_docs, line_share)
    cuts = lines.join(often, ["host", "h"]).groupBy("row").agg(F.collect_set("h").alias("cut"))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, cuts = b.column(0).flatten(), b.column(1).to_pylist()
            new = [without_lines(t, set(x or ())) for t, x in zip(columns[at].to_pylist(), cuts)]
            columns[at] = pa.array(new, columns[at].type)
            if chars in names:
                k = names.index(chars)
                columns[k] = pa.array([len(t) if x else n for n, t, x in zip(columns[k].to_pylist(), new, cuts)], columns[k].type)
            yield pa.record_batch(columns, names)

    return own.join(cuts, "row", "left").select("doc", "cut").mapInArrow(run, schema)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
c AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS ws FROM l),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lw WHERE len(ws) > 0 GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY 1),
norm AS (SELECT doc_id, host, array_to_string(ws, ' ') AS h, sum(len(ws)) AS nw FROM lw WHERE len(ws) > 0 GROUP BY 1, 2, 3),
often AS (SELECT n.host, n.h FROM (SELECT host, h, count(*) AS n FROM norm GROUP BY 1, 2) n
          JOIN (SELECT host, count(*) AS docs FROM d GROUP BY 1) s ON n.host = s.host WHERE n.n > {LINE_DOCS} AND n.n > s.docs * {LINE_SHARE}),
gone AS (SELECT doc_id, sum(nw)::BIGINT AS removed_words FROM norm JOIN often ON norm.host = often.host AND norm.h = often.h GROUP BY 1)
SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       (n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * n_words) AS base_failed,
       (NOT (n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * n_words) AND 2 * coalesce(removed_words, 0) <= n_words) AS kept,
       coalesce(removed_words, 0) AS removed_words
FROM c LEFT JOIN dup ON c.doc_id = dup.doc_id LEFT JOIN cov ON c.doc_id = cov.doc_id LEFT JOIN gone ON c.doc_id = gone.doc_id
"""
