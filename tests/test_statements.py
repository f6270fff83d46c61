"""What a run asks and keeps once, and statements it does without."""

import json

import pytest
from pyspark.sql import functions as F

from findmark.operators import judge, runs
from findmark.sources.scratch import empty, together
from findmark.sources.stages import Stages


@pytest.fixture
def lists(spark):
    one = lambda i: [(i, "cyst", "abnormal", None)]
    item = "array<struct<finding_id:string,text:string,clinical_status:string,laterality:string>>"
    return spark.createDataFrame([(s, one("a"), one("b")) for s in ("s1", "s2")], f"series_uuid string, pred_findings {item}, gt_findings {item}")


@pytest.mark.parametrize("bad, attempts", [((), [0]), (("s2",), [0, 1])])
def test_nothing_is_asked_when_no_series_is_open(spark, lists, bad, attempts):
    asked, right = [], json.dumps({"matches": [{"pred_id": "a", "gt_id": "b"}], "unmatched_pred": [], "unmatched_gt": []})

    def ask(requests, attempt):
        asked.append(attempt)
        return requests.select("series_uuid", F.when(F.col("series_uuid").isin(*bad, "") & F.lit(attempt == 0), "no JSON").otherwise(right).alias("reply"))

    out = judge.match_with_retries(lists, empty(spark, "series_uuid string, indication string"), "", ask)
    assert sorted((r.series_uuid, r.retries, r.validation_fallback, len(r.pairs)) for r in out.collect()) == [("s1", 0, False, 1), ("s2", len(bad), False, 1)]
    assert asked == attempts


def test_both_sides_are_extracted_by_one_call(spark, tmp_path):
    reports = spark.createDataFrame([(f"s{i}", side, f"{side} {i}") for i in range(3) for side in ("gt", "pred")], "series_uuid string, side string, text string")
    asked = []

    def extract(requests, attempt):
        asked.append("extraction")
        bad = (F.col("side") == "gt") & (F.col("series_uuid") == "s1")
        return requests.select("series_uuid", "side", F.when(bad, "no JSON").otherwise('{"findings": [{"text": "cyst"}]}').alias("reply"))

    def match(requests, attempt):
        asked.append("matching")
        ids = F.concat("series_uuid", F.lit("_001"))
        reply = F.struct(F.array(F.struct(ids.alias("pred_id"), ids.alias("gt_id"))).alias("matches"))
        return requests.select("series_uuid", F.to_json(reply).alias("reply"))

    def attributes(requests, attempt):
        return requests.select("series_uuid", "chunk", "part", F.lit(None).cast("string").alias("reply"))

    root = str(tmp_path / "store")
    out = runs.run(spark, root, reports, runs.Judges(extract, match, attributes), buckets=2)
    assert asked == ["extraction", "matching"]
    assert [(r.stage, r.series_uuid, r.reason) for r in out.failures.collect()] == [("extraction", "s1", "not JSON")]
    # the side that was read stays read: a series fails by side
    state = lambda side: sorted(r.series_uuid for r in Stages(spark, root, 2).state(f"findings-{side}", "series_uuid string").collect())
    assert state("gt") == ["s0", "s2"] and state("pred") == ["s0", "s1", "s2"]
    assert sorted(r.series_uuid for r in out.records.collect()) == ["s0", "s2"]


def test_a_table_without_rows_costs_no_job(spark):
    none = empty(spark, "series_uuid string, n int, a array<string>")
    assert none.dtypes == [("series_uuid", "string"), ("n", "int"), ("a", "array<string>")]
    plan = spark.range(3).select(F.col("id").cast("string").alias("series_uuid")).join(none, "series_uuid", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_calls_together_keep_their_order_and_errors(spark):
    assert together(spark, lambda: spark.range(3).count(), lambda: spark.range(5).count()) == [3, 5]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 // 0)
