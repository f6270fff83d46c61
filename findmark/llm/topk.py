"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of whole weights.  Queries are sent to the tasks in passes of bounded size; candidates are read
where they are and never dealt out.  A task takes its candidates by blocks: a block's terms are postings; the queries' weights of a
term scatter into dense score arrays over the block; a partition selects each query's best, which the task keeps from block
to block, and a last merge over the tasks ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import stored

#: Candidates and queries of a block; weights of the queries of a pass; candidates of a task at least.
CANDIDATES, QUERIES, PASS, TASK = 1024, 1024, 1 << 20, 4096
_MOST = (1 << 63) - 1
_FOUND = "query_id long, vec_id long, score long"


def whole_weights(vector: Column | str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column | str) -> Column:
    """True for vectors that are not null and have finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sparse(lists: pa.ListArray) -> Rows:
    """Row, term and weight of the weights that are not zero or null, in order of terms."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    weight = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(size) - size, size)
    own = weight != 0
    order = np.argsort(term[own], kind="stable")
    return row[own][order], term[own][order], weight[own][order]


def scores(n_queries: int, n: int, queries: Rows, candidates: Rows) -> np.ndarray:
    """Inner products of all queries with all candidates, term after term; what is beyond 2^63 - 1 in size becomes that."""
    (q_row, q_term, q_weight), (row, term, weight) = queries, candidates
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most(q_weight) * most(weight) * (int(term.max(initial=0)) + 1) > _MOST:  # sums of Python's whole numbers
        out = np.zeros((n_queries, n), object)
        for t in np.intersect1d(q_term, term):
            own, found = (x[slice(*np.searchsorted(term, [t, t + 1]))] for x in (row, weight.astype(object)))
            for q, w in zip(*(x[slice(*np.searchsorted(q_term, [t, t + 1]))].tolist() for x in (q_row, q_weight))):
                out[q, own] += w * found
        return np.clip(out, -_MOST, _MOST).astype(np.int64)
    out = np.zeros((n_queries, n), np.int64)
    for t in np.intersect1d(q_term, term):
        a, b = np.searchsorted(term, [t, t + 1])
        qa, qb = np.searchsorted(q_term, [t, t + 1])
        own, found = row[a:b], weight[a:b]
        if 4 * len(own) < n:  # few postings: only they are touched
            for q, w in zip(q_row[qa:qb].tolist(), q_weight[qa:qb].tolist()):
                out[q, own] += w * found
        else:
            postings = np.zeros(n, np.int64)
            postings[own] = found
            for q, w in zip(q_row[qa:qb].tolist(), q_weight[qa:qb].tolist()):
                out[q] += w * postings
    return out


def _best(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> Rows:
    """``(query, vec_id, score)``: the best ``k`` of each query's row; ``ids`` ascend, and a query's own id does not count."""
    found = []
    for q, s in zip(q_ids.tolist(), score):
        own = np.flatnonzero(ids != q)
        s = s[own]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            over = np.flatnonzero(s > least)
            pick = np.append(over, np.flatnonzero(s == least)[: k - len(over)])
        else:
            pick = np.arange(len(s))
        found.append((np.full(len(pick), q), ids[own[pick]], s[pick]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def _kept(found: list[Rows], k: int) -> Rows:
    """The best ``k`` of each query, ties to the smaller id."""
    query, vec, score = map(np.concatenate, zip(*found))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    return query[rank < k], vec[rank < k], score[rank < k]


def _searcher(blocks, k: int):
    """``blocks`` is a broadcast list of ``(ids, sparse rows)`` of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[Rows] = []

        def search(table: pa.Table) -> None:
            ids = table["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            lists = table["weights"].take(pa.array(order)).combine_chunks()
            rows = _sparse(lists)
            for q_ids, queries in blocks.value:
                found.append(_best(q_ids, ids[order], scores(len(q_ids), len(ids), queries, rows), k))
            if len(found) > 64:
                found[:] = [_kept(found, k)]

        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                held.append(batch.slice(at, CANDIDATES))
                if sum(b.num_rows for b in held) >= CANDIDATES:
                    search(pa.Table.from_batches(held))
                    held = []
        if held:
            search(pa.Table.from_batches(held))
        if found:
            yield pa.record_batch([pa.array(c) for c in _kept(found, k)], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries(vec_id, weights)`` the ``k`` highest inner products among
    ``candidates(vec_id, weights)`` of another ``vec_id``; ties go to the smaller one.

    Missing terms weigh nothing.  Queries that share an id count once (the smallest weights); candidates that share one
    each count.  Scores beyond 2^63 - 1 in size become that.  Rows without id or weights take no part; no queries or no candidates give no row; other columns are not read.
    Passes follow each other, each over all candidates, as the queries are more than a task's memory may hold.
    """
    spark = queries.sparkSession
    queries, candidates = (x.select(F.col("vec_id").cast("long").alias("vec_id"), "weights").where("vec_id is not null and weights is not null") for x in (queries, candidates))
    queries = stored(queries.groupBy("vec_id").agg(F.min("weights").alias("weights")), "queries")
    candidates = stored(candidates, "candidates")
    size = queries.agg(F.sum(F.greatest(F.size("weights"), F.lit(1))).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // PASS))
    # tiny partitions are read together, so that a task's best are few beside its candidates
    tasks = max(spark.sparkContext.defaultParallelism, -(-candidates.count() // TASK))
    candidates = candidates.coalesce(tasks)
    parts = []
    for i in range(passes):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow().combine_chunks()
        ids = own["vec_id"].to_numpy()
        cuts = range(0, len(ids), QUERIES)
        blocks = spark.sparkContext.broadcast([(ids[at : at + QUERIES], _sparse(own["weights"].slice(at, QUERIES).combine_chunks())) for at in cuts])
        found = candidates.mapInArrow(_searcher(blocks, k), _FOUND)
        if passes > 1:
            found = stored(found, "found")
            blocks.destroy()
        parts.append(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
