"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features; each step fits a tree of three leaves to the residual's histogram over one feature's bins
and adds it to that feature's table.  Then the pairs of features with the largest gain get tables of their own, by steps of
one cut on either axis.  A document's score is the sum of its bins' entries, looked up for a whole batch at once.

The model learns from a bounded sample of the labelled rows (``most`` of them, by a hash of the id), the only rows that
reach the driver.  Inputs are counts over the whole text; label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from.
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_length", "symbols", "digits", "marks", "capitals", "distinct_words", "distinct_lines", "line_words",
    "long_words", "top_word", "beyond_ascii", "same_again", "distinct_pairs", "single_letters", "short_lines",
)


def measure(text: str | None) -> list[float]:
    """The model's inputs, in the order of ``FEATURES``; an empty or null text gives zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    per_line = [len(x.split()) for x in lines]
    return [
        float(np.log1p(n)), float(lengths.mean()), without(b"#*$%&|<>@_~^=+\\/{}[]"), without(b"0123456789"), without(b".,;:!?"),
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(counts) / n, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        float((lengths > 14).mean()), max(counts.values()) / n, without(bytes(range(128, 256))),
        sum(map(bytes.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, float((lengths == 1).mean()),
        sum(k <= 3 for k in per_line) / len(lines),
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree of up to three leaves over ordered bins."""

    def cut(a: int, b: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if b - a < 2:
            return 0.0, a
        left = cg[:-1] ** 2 / (ch[:-1] + ridge)
        right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
        gain = left + right - cg[-1] ** 2 / (ch[-1] + ridge)
        i = int(np.argmax(gain))
        return float(gain[i]), a + i + 1

    first, at = cut(0, len(g))
    edges = [0, len(g)]
    if first > 0:
        edges = [0, at, len(g)]
        second = max(cut(0, at), cut(at, len(g)))
        if second[0] > 0:
            edges = sorted({*edges, second[1]})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best one-cut-on-either-axis partition of a grid: its gain and its leaf values by cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((cg[-1, -1] - sum(x for x, _ in parts), ch[-1, -1] - sum(x for _, x in parts)))
    gain = sum(x**2 / (np.maximum(y, 0) + ridge) for x, y in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (x, y), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2):
        out[rows, cols] = x[i, j] / (max(y[i, j], 0) + ridge)
    return float(gain[i, j]), out


@dataclass
class Gam:
    """``base`` plus a table over each feature's bins and one over each chosen pair's."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        for (i, j), grid in zip(self.pairs, self.grids):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return _sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 1.0) -> Gam:
    """Learns from rows ``x`` and labels ``y`` (0 or 1); without both labels the score is constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(base=float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    edges = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
    model.cuts = [edges(v, bins) for v in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, b in enumerate(binned):
            p = _sigmoid(z)
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), ridge)
            model.tables[f] += step
            z += step[b]
    model.coarse = [edges(v, pair_bins) for v in x.T]
    binned = [np.searchsorted(c, v, "right") for c, v in zip(model.coarse, x.T)]

    def grid(i: int, j: int) -> tuple[float, np.ndarray, np.ndarray]:
        p, n, m = _sigmoid(z), len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell = binned[i] * m + binned[j]
        gain, step = _quadrants(np.bincount(cell, y - p, n * m).reshape(n, m), np.bincount(cell, p * (1 - p), n * m).reshape(n, m), ridge)
        return gain, step, cell

    usable = [(i, j) for i, j in combinations(range(x.shape[1]), 2) if len(model.coarse[i]) and len(model.coarse[j])]
    model.pairs = sorted(usable, key=lambda p: -grid(*p)[0])[:n_pairs]
    model.grids = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            _, step, cell = grid(i, j)
            model.grids[k] += rate * step
            z += (rate * step).ravel()[cell]
    return model


def fold(mod: int) -> Column:
    """``crc32`` of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([measure(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([x, *b.columns[1:]], ["x", *more])

    kinds = dict(docs.dtypes)
    return docs.select("text", *more).mapInArrow(run, ", ".join(["x array<double>", *(f"{m} {kinds[m]}" for m in more)]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Gam:
    """A model of ``labels(doc_id, <label>)`` over ``docs(doc_id, text)``; rows with a null id or label are not used, of
    several labels of an id the smallest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    sample = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not sample:
        return Gam()
    sample = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in sample], "doc_id long, y int"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    rows = sorted((r.doc_id, r.y, *r.x) for r in _measured(own, "doc_id", "y").collect())
    x = np.array([r[2:] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], float)) if rows else Gam()


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``, other columns are not read.

    Null texts are scored as empty ones; rows that share an id, or have none, each give a row; a text of any length is
    measured whole; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measure(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
