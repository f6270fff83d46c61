"""Hard negatives by angular triangle filtering.

Each row keeps its angles to a few reference directions, the means of the most frequent labels, and its norm.  Two angles to a
direction give an interval for the angle between two rows, hence for its cosine, and with both norms for the score; the
intervals of all directions are intersected and widened beyond any rounding.  Anchors go out in passes of bounded size,
candidates are read where they are.  A task scores a candidate with whole numbers only where its interval overlaps the window of
a positive of the anchor, whose lower end rises to the tenth best that the task has found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import stored

#: Weights of the anchors of a pass; candidates of a task at least.
PASS, TASK = 1 << 20, 4096
#: Part of the product of two norms by which an interval is widened; an angle is off by less than a thousandth of it.
SLACK = 1e-5
_ROW = "vec_id long, label long, weights array<bigint>"
#: The ends of a score.
_LEAST, _MOST = 1 - (1 << 63), (1 << 63) - 1


def dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``lists`` as a matrix of ``width`` columns; missing and null weights are zero."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    term = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    value = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    own = term < width
    out[np.repeat(np.arange(len(size)), size)[own], term[own]] = value[own]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of ``a`` with those of ``b``; what is beyond 2^63 - 1 in size becomes that."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = most(a) * most(b) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


def directions(rows: DataFrame, width: int, most: int = 8) -> np.ndarray:
    """Unit mean vectors, ``width`` long, of the labels that most rows have, at most ``most``; a mean of zero is left out."""
    frequent = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most).select("label")
    sums = rows.join(F.broadcast(frequent), "label").select("label", F.posexplode("weights").alias("at", "w")).groupBy("label", "at").agg(F.avg("w").alias("w")).toPandas()
    means = np.zeros((sums["label"].nunique(), width))
    means[sums["label"].rank(method="dense").to_numpy(np.int64) - 1, sums["at"].to_numpy(np.int64)] = sums["w"].fillna(0.0)
    norm = np.linalg.norm(means, axis=1)
    return means[norm > 0] / norm[norm > 0, None]


def angles(weights: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(norms, angles to the references)`` of rows; a row of zeros is at a right angle to everything."""
    x = weights.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    return norm, np.arccos(np.clip((x @ references.T) / np.where(norm, norm, 1.0)[:, None], -1.0, 1.0))


def intervals(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all rows ``a`` with all rows ``b``, each given as ``angles`` gives them.

    The angle of two rows is at least the difference and at most the sum of their angles to a direction.
    """
    (a_norm, a_angle), (b_norm, b_angle) = a, b
    scale = np.outer(a_norm, b_norm)
    low, high = np.full(scale.shape, -1.0), np.ones(scale.shape)
    for j in range(a_angle.shape[1]):
        both = np.outer(np.cos(a_angle[:, j]), np.cos(b_angle[:, j]))
        across = np.outer(np.sin(a_angle[:, j]), np.sin(b_angle[:, j]))
        np.minimum(high, both + across, out=high)  # cosine of the difference
        np.maximum(low, both - across, out=low)  # cosine of the sum
    return (low - SLACK) * scale - 1, (high + SLACK) * scale + 1


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores from ``low`` to ``high`` per cent of ``score``; empty where the first is the larger one."""
    return max(-(-low * score // 100), _LEAST), max(min(high * score // 100, _MOST), _LEAST)


class Best:
    """The best rows of one anchor and positive: highest score first, ties by id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.full = k, np.zeros(0, np.int64), np.zeros(0, np.int64), _LEAST

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.append(self.ids, ids)
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.k:
            self.full = self.score[-1]


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Rows in tables of about ``block``, by id."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            held.append(batch.slice(at, block))
            if sum(b.num_rows for b in held) >= block:
                yield pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()


def _lists(table: pa.Table, column: str) -> pa.ListArray:
    return table[column].combine_chunks()


def _positives(anchors, k: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` rows of each anchor's own label; ``anchors`` is a broadcast ``(ids, labels, weights)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, weights = anchors.value
        best = [Best(k) for _ in ids]
        for table in _blocks(batches, block):
            own_ids, own_labels, own = table["vec_id"].to_numpy(), table["label"].to_numpy(), dense(_lists(table, "weights"), weights.shape[1])
            for label in np.intersect1d(labels, own_labels):
                rows, found = np.flatnonzero(labels == label), own_labels == label
                for a, score in zip(rows.tolist(), products(weights[rows], own[found])):
                    good = (score >= best[a].full) & (own_ids[found] != ids[a])
                    if good.any():
                        best[a].add(score[good], own_ids[found][good])
        yield from _found(best, ids, None)

    return run


def _found(best: list[Best], ids: np.ndarray, positive: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n = [len(b.ids) for b in best]
    if sum(n):
        columns = [np.repeat(ids, n), *([] if positive is None else [np.repeat(positive, n)]), np.concatenate([b.ids for b in best]), np.concatenate([b.score for b in best])]
        yield pa.record_batch([pa.array(c) for c in columns], ["anchor_id", *([] if positive is None else ["nth"]), "vec_id", "score"])


def _negatives(anchors, windows, references: np.ndarray, k: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each window of each anchor the best ``k`` rows of another label in it; ``windows`` is a broadcast
    ``(row of the anchor, low, high)``, in order of the anchors, with the positives' numbers behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, weights = anchors.value
        row, low, high, nth = windows.value
        best = [Best(k) for _ in row]
        told = angles(weights, references)
        upto = np.searchsorted(row, np.arange(len(ids) + 1))
        need, most = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        np.maximum.at(most, row, high)
        for table in _blocks(batches, block):
            own_ids, own_labels, own = table["vec_id"].to_numpy(), table["label"].to_numpy(), dense(_lists(table, "weights"), weights.shape[1])
            own_told = table["norm"].to_numpy(), np.array(_lists(table, "angles").flatten()).reshape(len(own_ids), -1)
            floor = np.maximum(low, [b.full for b in best])
            need[:] = np.inf
            np.minimum.at(need, row, floor)
            for begin in range(0, len(ids), block):
                some = slice(begin, begin + block)
                lower, upper = intervals((told[0][some], told[1][some]), own_told)
                overlap = (upper >= need[some, None]) & (lower <= most[some, None]) & (labels[some, None] != own_labels)
                for a in np.flatnonzero(overlap.any(1)).tolist():
                    found = np.flatnonzero(overlap[a])
                    a += begin
                    score = products(weights[a : a + 1], own[found])[0]
                    order = np.argsort(-score, kind="stable")  # candidates are in order of ids
                    found, score = found[order], score[order]
                    for w in range(upto[a], upto[a + 1]):
                        x, y = np.searchsorted(-score, -high[w]), np.searchsorted(-score, -floor[w], "right")
                        if x < y:
                            best[w].add(score[x : min(y, x + k)], own_ids[found[x : min(y, x + k)]])
        yield from _found(best, ids[row], nth)

    return run


def _angled(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows with ``norm`` and ``angles`` to the reference directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, angle = angles(dense(batch.column(2), references.shape[1]), references)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(norm) + 1) * angle.shape[1], pa.int32()), pa.array(angle.ravel()))
            yield pa.record_batch([*batch.columns, pa.array(norm), lists], ["vec_id", "label", "weights", "norm", "angles"])

    return rows.mapInArrow(run, _ROW + ", norm double, angles array<double>")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, references: int = 8, block: int = 2048) -> DataFrame:
    """``anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score``.

    The positives of an anchor are the ``positives`` rows of its label, of another ``vec_id``, with the highest inner products; for
    each of them the ``negatives`` best rows of another label follow whose score is from ``low`` to ``high`` per cent of the
    positive's.  Ties go to the smaller id.

    ``rows`` and ``anchors`` have ``vec_id, label, weights``; rows with a null among them take no part, and null or missing
    weights are zeros.  Anchors that share an id count once (the smallest label and weights); rows that share one each count.
    Scores beyond 2^63 - 1 in size become that.  A positive without such negatives has no row; no anchors or no rows give none; other
    columns are not read.  Vectors may differ in length; a block is as wide as the longest.  ``references`` (directions)
    and ``block`` (rows and anchors compared at once) only decide how many are scored, and the memory.
    """
    spark = rows.sparkSession
    whole = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("weights").cast("array<bigint>").alias("weights")).where("vec_id is not null and label is not null and weights is not null")
    anchors = stored(whole(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "weights")).alias("x")).select("vec_id", "x.*"), "anchors")
    rows = stored(whole(rows), "rows")
    width = rows.agg(F.max(F.size("weights"))).first()[0] or 0
    unit = directions(rows, width, references)
    told = stored(_angled(rows, unit), "angles")
    size = anchors.agg(F.sum(F.greatest(F.size("weights"), F.lit(1)))).first()[0]
    passes = max(1, -(-(size or 0) // PASS))
    # tiny partitions are read together, so that a task's best are few beside its candidates
    tasks = max(spark.sparkContext.defaultParallelism, -(-told.count() // TASK))
    told = told.coalesce(tasks)
    parts = []
    for i in range(passes):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).orderBy("vec_id").toArrow().combine_chunks()
        ids = own["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, own["label"].to_numpy(), dense(_lists(own, "weights"), width)))
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        found = told.mapInArrow(_positives(sent, positives, block), "anchor_id long, vec_id long, score long").withColumn("nth", F.row_number().over(best).cast("long")).where(F.col("nth") <= positives)
        found = stored(found, "positives")
        pairs = found.toPandas().sort_values(["anchor_id", "nth"])  # at most a pass's anchors, each ``positives`` times
        spans = [window(int(s), low, high) for s in pairs["score"]]
        real = np.array([a <= b for a, b in spans], bool)
        row = np.searchsorted(ids, pairs["anchor_id"].to_numpy())
        spans = np.array(spans, np.int64).reshape(-1, 2)[real]
        windows = spark.sparkContext.broadcast((row[real], spans[:, 0], spans[:, 1], pairs["nth"].to_numpy()[real]))
        hit = told.mapInArrow(_negatives(sent, windows, unit, negatives, block), "anchor_id long, nth long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "vec_id"))
        hit = hit.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        hit = hit.join(found.select("anchor_id", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "nth"])
        if passes > 1:
            hit = stored(hit, "negatives")
            sent.destroy()
            windows.destroy()
        parts.append(hit)
    out = reduce(DataFrame.unionByName, parts)
    return out.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("positive_rank"), F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
