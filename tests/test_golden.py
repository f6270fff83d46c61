"""Five series with one outcome each, the identities of the metrics, and measurement pairing against brute force."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from findmark.functions import comparators as C
from findmark.functions import rules as R
from findmark.operators import metrics, scoring

FIELDS = "series_uuid string, side string, finding_id string, text string, clinical_status string, clinical_significance string, laterality string, comparison string, measurements array<struct<value:double,unit:string,category:string>>"


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        ("s1", "gt", "a", "opacity", "abnormal", "urgent", "bilateral", None, []),
        ("s1", "pred", "a", "opacity", "abnormal", "urgent", "bilateral", None, []),
        ("s2", "gt", "a", "clot", "abnormal", "critical", "left", None, []),
        ("s2", "pred", "a", "clot", "abnormal", "critical", "right", None, []),
        ("s3", "gt", "a", "air", "abnormal", "critical", "left", "new", []),
        ("s3", "pred", "a", "no air", "normal", "critical", None, None, []),
        ("s4", "gt", "a", "nodule", "abnormal", "notable", None, "stable", [(6.0, "mm", "size")]),
        ("s5", "pred", "a", "clear", "normal", "routine", None, None, []),
    ]
    findings = spark.createDataFrame(rows, FIELDS)
    matches = spark.createDataFrame([(s, "a", "a") for s in ("s1", "s2", "s3")], "series_uuid string, pred_id string, gt_id string")
    whole = scoring.audit(findings.withColumn("pos", F.lit(1)), matches)
    assert whole.failures.count() == 0
    return whole.records, whole.orphans


def test_counts(scored):
    assert metrics.muc_counts(*scored).first().asDict() == {"COR": 1, "PAR": 0, "INC": 2, "MIS": 1, "SPU": 1}


def test_tiers(scored):
    rows = {r["tier"]: r for r in metrics.tier_metrics(*scored).collect()}
    wanted = {"all": (3, 1, 2, 0, 4, 1, 4, 1, 3), "significant": (3, 1, 2, 0, 4, 1, 4, 1, 3), "triage": (2, 0, 2, 0, 3, 1, 3, 1, 3), "critical": (2, 0, 2, 0, 2, 0, 2, 0, 2)}
    for tier, (errors, mis, inc, fp, stake, hits, total, p_hits, p_total) in wanted.items():
        r = rows[tier]
        assert (r.errors, r.fn_mis, r.fn_inc, r.fp, r.findings_at_stake, r.recall_hits, r.recall_total, r.precision_hits, r.precision_total) == (errors, mis, inc, fp, stake, hits, total, p_hits, p_total)
        assert r.errors == r.fn + r.fp and r.fn == r.recall_total - r.recall_hits and r.errors <= r.findings_at_stake


def test_subsets_and_breakdown(scored):
    sub = {r["subset"]: r.asDict() for r in metrics.muc_counts(*metrics.by_subset(*scored), ["subset"]).collect()}
    assert sub["abnormal-regular"]["COR"] == 1 and sub["abnormal-regular"]["INC"] == 1
    assert sub["comparison"]["INC"] == 1 and sub["comparison"]["MIS"] == 1
    assert sub["measurement"]["MIS"] == 1 and sub["normal-regular"]["SPU"] == 1
    rows = {r["dimension"]: (r.clean, r.minor, r.major) for r in metrics.attribute_breakdown(scored[0]).collect()}
    assert rows["clinical_status"] == (2, 0, 1) and rows["laterality"] == (2, 0, 1) and rows["grade"] == (3, 0, 0)


def test_empty_pool_is_null(spark, scored):
    records, orphans = scored
    counts = metrics.tier_counts(records.where("gt_sig = 'urgent'"), orphans.where("false"))
    r = {x["tier"]: x for x in metrics.with_rates(counts).collect()}["critical"]
    assert r["recall"] is None and r["precision"] is None and r["errors_per_finding"] == 0.0


def test_assignment_matches_brute_force(spark):
    rnd = random.Random(1)
    cases = [([float(rnd.randint(0, 5)) for _ in range(k)], [float(rnd.randint(0, 5)) for _ in range(k + rnd.randint(0, 2))]) for k in (1, 2, 3, 4) for _ in range(15)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<double>, b array<double>")
    rows = df.select("i", C.best_assignment(F.col("a"), F.col("b")).alias("x"), C.sorted_assignment(F.col("a"), F.col("b"))["cost"].alias("s")).collect()
    for r in rows:
        a, b = cases[r.i]
        best = min((sum(abs(x - b[j]) for x, j in zip(a, p)), p) for p in permutations(range(len(b)), len(a)))
        assert (r.x.cost, tuple(r.x.idx)) == best and r.s == best[0]


def test_assignment_of_eight_to_eight_with_ties(spark):
    """All 40,320 tuples against the programme over subsets."""
    rnd = random.Random(3)
    cases = [([float(rnd.randint(0, 3)) for _ in range(k)], [float(rnd.randint(0, 3)) for _ in range(n)]) for k, n in ((8, 8), (8, 8), (5, 8), (2, 8), (1, 1))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<double>, b array<double>")
    for r in df.select("i", C.best_assignment(F.col("a"), F.col("b")).alias("x")).collect():
        a, b = cases[r.i]
        assert (r.x.cost, tuple(r.x.idx)) == min((sum(abs(x - b[j]) for x, j in zip(a, p)), p) for p in permutations(range(len(b)), len(a)))


@pytest.mark.parametrize(
    ("category", "p", "g", "wanted"),
    [
        ("size", (12.0, "mm"), (1.0, "cm"), None), ("size", (13.0, "mm"), (1.0, "cm"), "minor"), ("size", (2.0, "mm"), (3.0, "mm"), None), ("size", (5.0, "mm"), (5.0, "ml"), "minor"), ("size", (5.0, None), (5.0, "ml"), None),
        ("ratio", (66.0, "pct"), (50.0, "pct"), "major"), ("ratio", (65.0, "pct"), (50.0, "pct"), None), ("count", (2.0, None), (3.0, None), "major"),
        ("attenuation", (11.0, "hu"), (9.0, "hu"), "major"), ("attenuation", (45.0, "hu"), (30.0, "hu"), None), ("attenuation", (60.0, "hu"), (30.0, "hu"), "major"), ("other", (1.0, None), (2.0, None), "minor"),
    ],
)
def test_comparators(spark, category, p, g, wanted):
    m = "struct<value:double,unit:string,category:string>"
    df = spark.createDataFrame([((*p, category), (*g, category))], f"p {m}, g {m}")
    assert df.select(C.COMPARATORS[category](F.col("p"), F.col("g")).alias("s")).first()["s"] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("2.3 cm cyst", [(2.3, "cm", "size")]), ("mass of 3.8 x 3.0 cm", [(3.8, "cm", "size"), (3.0, "cm", "size")]), ("3 x 4 x 5 mm node", [(3, "mm", "size"), (4, "mm", "size"), (5, "mm", "size")]),
        ("3 mm x 4 mm", [(3, "mm", "size"), (4, "mm", "size")]), ("nodules of 3-4 mm", [(3, "mm", "size"), (4, "mm", "size")]), ("Decreased from 8 mm to 5 mm", [(5, "mm", "size")]), ("Sub-5 mm nodules", [(5, "mm", "size")]),
        ("26 Hounsfield units", [(26, "hu", "attenuation")]), ("SUV max 4.2", [(4.2, None, "other")]), ("50% stenosis", [(50, "pct", "ratio")]), ("3 lymph nodes", [(3, None, "count")]), ("2 small calcified nodules", [(2, None, "count")]),
        ("Agatston score 120", [(120, None, "other")]), ("Aneurysm 4 cm above the bifurcation", [(4, "cm", "other")]), ("now 6 mm, previously 9 mm", [(6, "mm", "size")]), ("formerly measured 2 x 3 cm", []),
        ("seen in 3 places at T12 on 3.4.2020", []), ("", []), (None, None),
    ],
)
def test_numbers_of_a_text(spark, text, wanted):
    found = spark.createDataFrame([(text,)], "t string").select(R.numbers("t").alias("m")).first().m
    assert (found and [tuple(m) for m in found]) == wanted
