"""Packing by exact complements.

A document's ids are cut only where they are more than a sequence holds.  Pieces are written once, with the number that each
has among the pieces of its length in its task.  Only counts by length go on: lengths are at most the capacity, so the
histogram is as small at any size of the corpus.  From it a plan is made: sums of one, two and three lengths are indexed, the
longest piece that is left opens a sequence, and a combination whose sum is exactly the gap fills it, as often as the counts
allow.  Where no combination fits, the longest piece that fits goes in first (best fit) and the smaller gap is looked up.
Pieces then find their places by their length and rank: a count before their task and the number within it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import lean, stored
from findmark.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Complements:
    """Lengths that are left, and the index of their sums: which one, two or three of them fill a gap exactly."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        lengths = np.flatnonzero(self.left)
        a, b = (lengths[i] for i in np.triu_indices(len(lengths)))
        inside = a + b <= capacity
        a, b = a[inside], b[inside]
        order = np.argsort(a + b, kind="stable")
        self.a, self.b = a[order], b[order]  # pairs by their sum
        self.at = np.searchsorted((a + b)[order], np.arange(capacity + 2))

    def longest(self, room: int) -> int:
        """The longest length up to ``room`` that is left, or zero."""
        found = np.flatnonzero(self.left[: room + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, gap: int) -> tuple[int, ...]:
        """The two lengths with this sum that are left most often."""
        a, b = (x[self.at[gap] : self.at[gap + 1]] for x in (self.a, self.b))
        if not len(a):
            return ()
        often = np.where(a == b, self.left[a] // 2, np.minimum(self.left[a], self.left[b]))
        best = int(np.argmax(often))
        return (int(a[best]), int(b[best])) if often[best] else ()

    def find(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths with this sum; the fewest that do."""
        if self.left[gap]:
            return (gap,)
        most = self.longest(gap)
        if gap <= 2 * most and (found := self.pair(gap)):
            return found
        if gap <= 3 * most:
            third = np.flatnonzero(self.left[:gap])
            for c in third[np.argsort(-self.left[third], kind="stable")].tolist():
                self.left[c] -= 1
                found = self.pair(gap - c)
                self.left[c] += 1
                if found:
                    return (*found, c)
        return ()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of lengths, each with a sum of at most ``capacity``, and how often each is used; together all of ``counts``."""
    index, out = Complements({k: n for k, n in counts.items() if n}, capacity), []
    left = index.left
    while first := index.longest(capacity):
        used: dict[int, int] = defaultdict(int)
        gap, some = capacity, (first,)
        while some:
            for k in some:
                left[k] -= 1
                used[k] += 1
                gap -= k
            some = (index.find(gap) or (index.longest(gap),)) if gap else ()
            if some == (0,):
                break
        more = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * more
        out.append((dict(used), 1 + more))
    return out


class Places:
    """Where the pieces of each length go: ranges of their ranks, and for each the sequence and the offset it begins with."""

    def __init__(self, planned: list[tuple[dict[int, int], int]]):
        rows, sequence = [], 0
        given: dict[int, int] = defaultdict(int)
        for used, times in planned:
            offset = 0
            for k in sorted(used, reverse=True):
                rows.append((k, given[k], used[k], sequence, offset))
                given[k] += used[k] * times
                offset += used[k] * k
            sequence += times
        rows.sort()
        self.length, self.rank, self.each, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        lengths = np.unique(self.length)
        self.begin = dict(zip(lengths.tolist(), zip(np.searchsorted(self.length, lengths).tolist(), np.searchsorted(self.length, lengths, "right").tolist())))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, offset)`` of pieces by length and rank."""
        row = np.empty(len(length), np.int64)
        for k in np.unique(length).tolist():
            own, (a, b) = length == k, self.begin[k]
            row[own] = a + np.searchsorted(self.rank[a:b], rank[own], "right") - 1
        nth = rank - self.rank[row]
        return self.sequence[row] + nth // self.each[row], self.offset[row] + nth % self.each[row] * length


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``, numbered by task and length: see ``_PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, ends = tokens.encode(batch.column(1))
            ids, begin, rows = ids.astype("<u4"), 0, []
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist()):
                for piece, at in enumerate(range(begin, end, capacity)):
                    n = min(capacity, end - at)
                    rows.append((doc_id, piece, at - begin, n, zlib.crc32(ids[at : at + n]), task, seen[n]))
                    seen[n] += 1
                begin = end
            if rows:
                columns = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows))]
                yield pa.record_batch(columns, [c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null").mapInArrow(lean(run, keeps=True), _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: see ``SCHEMA``.

    Null text is the empty text, which has the end id alone; rows without ``doc_id`` are left out; rows that share an id are
    packed one by one.  A text of any length is encoded whole; other columns are not read; an empty table gives no row.
    Pieces of the full length stand alone, under negative numbers.  Driver and tasks hold a histogram of at most ``capacity``
    lengths and its plan; a piece is dealt by its task and length once, so a common length is spread over all tasks.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = stored(cut.where(F.col("length") < capacity).groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    dealt = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(dealt), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(*(batch.column(c).to_numpy() for c in ("length", "rank")))
            yield pa.record_batch([*(batch.column(c) for c in range(5)), pa.array(sequence), pa.array(offset)], [c.split()[0] for c in SCHEMA.split(", ")])

    own = ("doc_id", "piece", "start", "length", "ids_crc32")
    short = cut.where(F.col("length") < capacity).join(before, ["task", "length"]).select(*own, (F.col("before") + F.col("nth")).alias("rank"))
    full = cut.where(F.col("length") == capacity).select(*own, (-1 - F.shiftleft("task", 40) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.mapInArrow(place, SCHEMA).unionByName(full)
