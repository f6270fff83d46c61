"""Hard negatives and whitening against brute force, and on odd rows."""

import random
from fractions import Fraction

import numpy as np
import pytest

from findmark.llm import hard_negatives as H
from findmark.llm import whitening as W

ROWS = "vec_id long, label long, weights array<long>, score long, angles string"  # the last two clash with names inside


def negatives_by_hand(rows, anchors, positives, negatives, low, high):
    rows = [r for r in rows if None not in r[:3]]
    dot = lambda a, b: sum((x or 0) * (y or 0) for x, y in zip(a, b))
    first = {}
    for i, label, w in sorted((r[:3] for r in anchors if None not in r[:3]), key=lambda r: (r[0], r[1], r[2])):
        first.setdefault(i, (label, w))
    out = []
    for i, (label, w) in first.items():
        told = sorted((-dot(w, x), j, own != label) for j, own, x, *_ in rows if j != i)
        for s, j, _ in [t for t in told if not t[2]][:positives]:
            fit = [t for t in told if t[2] and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(i, j, n + 1, t[1], -s, -t[0]) for n, t in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block,weights,spread", [(2048, 1 << 20, 30), (16, 64, 3), (16, 64, 1 << 29)])
def test_hard_negatives_like_brute_force(spark, monkeypatch, block, weights, spread):
    """Ties, a label that a third of the rows have, scores beyond a double's whole numbers, and several passes."""
    monkeypatch.setattr(H, "PASS", weights)
    rnd = random.Random(spread)
    rows = [(i, 0 if rnd.random() < 0.33 else rnd.randrange(5), [rnd.randint(-spread, spread) for _ in range(4)], i, "") for i in range(160)]
    rows += [(1000 + i, 1, rows[3][2], i, "") for i in range(30)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    anchors = [r for r in rows if r[0] % 20 == 0]
    found = H.hard_negatives(df, spark.createDataFrame(anchors, ROWS), 5, 4, 30, 90, block=block)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect()) == negatives_by_hand(rows, anchors, 5, 4, 30, 90)


def test_intervals_hold_every_score():
    rnd = np.random.default_rng(4)
    for scale in (1, 300, 1 << 40):
        a, b = rnd.integers(-scale, scale + 1, (40, 6)), rnd.integers(-scale, scale + 1, (50, 6))
        a[0], b[:6] = 0, a[:6] * 2
        refs = np.vstack([a[1:4], b[7:9]]).astype(float)
        refs /= np.linalg.norm(refs, axis=1)[:, None]
        low, high = H.intervals(H.angles(a, refs), H.angles(b, refs))
        exact = a.astype(object) @ b.astype(object).T
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low < 2e-3 * scale * scale + 3).sum() >= 50 * 3  # a row along a reference is known almost exactly


def test_intervals_leave_rows_out():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(4, 16))
    x = np.vstack([(200 * c + rnd.normal(size=(100, 16)) * 10) for c in centres]).astype(np.int64)
    refs = np.vstack([x[i * 100 : i * 100 + 100].mean(0) for i in range(4)])
    told = H.angles(x, refs / np.linalg.norm(refs, axis=1)[:, None])
    low, high = H.intervals(told, told)
    assert (high < 0.8 * np.outer(told[0], told[0])).mean() > 0.5


def test_odd_rows_of_hard_negatives(spark):
    big = 1 << 62
    rows = [(None, 1, [1, 2], 0, ""), (1, None, [1, 2], 0, ""), (2, 1, None, 0, ""), (3, 1, [2, 1], 0, ""), (3, 1, [2, 1], 0, ""), (4, 1, [2, None, 5], 0, ""), (5, 2, [1], 0, ""), (5, 2, [1], 0, ""), (6, 2, [], 0, ""), (7, 1, [0, 0], 0, ""), (8, 3, [big, big], 0, ""), (9, 3, [big, big], 0, ""), (10, 4, [1, 1], 0, "")]
    df = spark.createDataFrame(rows, ROWS)
    found = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in H.hard_negatives(df, df, 2, 3, 0, 90).orderBy("anchor_id", "positive_rank", "rank").collect()]
    assert found[0] == (3, 4, 1, 10, 4, 3) and (8, 9, 1, 4, (1 << 63) - 1, big * 2) not in found
    assert {f[0] for f in found} <= {3, 4, 5, 6, 7, 8, 9}
    assert [f for f in found if f[:2] == (5, 5)] == []  # another row is one of another id
    for some, other in ((df.where("false"), df), (df, df.where("false"))):
        assert H.hard_negatives(some, other).count() == 0


VECTORS = "vec_id long, x array<long>, n long, total string"


def test_covariance_is_exact(spark):
    rnd = random.Random(6)
    for spread, start in ((50, 1_000_000), (1 << 45, -(1 << 50))):
        rows = [(i, [start + rnd.randint(-spread, spread) for _ in range(4)], 0, "") for i in range(300)]
        n, pivot, rest, found = W.covariance(spark.createDataFrame(rows, VECTORS).repartition(5))
        x = [r[1] for r in rows]
        mean = [Fraction(sum(r[j] for r in x), n) for j in range(4)]
        assert n == 300 and [Fraction(int(pivot[j]) * n + int(rest[j]), n) for j in range(4)] == mean
        for i in range(4):
            for j in range(4):
                exact = sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n
                assert found[i, j] == pytest.approx(float(exact), rel=1e-14, abs=0)


def test_whitening_like_brute_force(spark):
    rnd = np.random.default_rng(7)
    x = np.floor(64 * (rnd.normal(size=(500, 6)) @ rnd.normal(size=(6, 6)))).astype(np.int64) + 1_000_000
    rows = W.whitened(spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(x.tolist())], VECTORS).repartition(4), 4).collect()
    assert len(rows) == 500 * 4 and {r.n for r in rows} == {500}
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / 500)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = np.zeros((500, 4))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        assert r.deviation == sum((500 * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], x.sum(0)))
    wanted = centred @ vectors[:, :4] / np.sqrt(values[:4])
    assert np.allclose(np.abs(got), np.abs(wanted), atol=1e-9)
    assert np.allclose(got.T @ got / 500, np.eye(4), atol=1e-9)


def test_odd_rows_of_whitening(spark):
    rows = [(1, None, 0, ""), (2, [1, None], 0, ""), (3, [1, 2], 0, ""), (3, [1, 2], 0, ""), (None, [5, 1], 0, ""), (4, [1], 0, ""), (5, [], 0, ""), (6, [2, 2], 0, "")]
    found = W.whitened(spark.createDataFrame(rows, VECTORS), 32).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (3, 1), (3, 1), (3, 2), (3, 2), (6, 1), (6, 2)]
    same = spark.createDataFrame([(i, [7, 7], 0, "") for i in range(3)], VECTORS)
    assert W.whitened(same).count() == 0 and W.whitened(same.where("false")).count() == 0
    flat = W.whitened(spark.createDataFrame([(i, [i, 2 * i, 7], 0, "") for i in range(9)], VECTORS)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)


def test_entries_beyond_longs(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300, 0.5, -0.01])], "vec_id long, v array<double>")
    assert df.select(W.whole_entries("v").alias("x")).first().x == [(1 << 62) + 1_000_000, -(1 << 62) + 1_000_000, 1_000_032, 999_999]
