"""Steps between findings and records: what is checked in place, and what is not gathered or read again."""

import pytest
from pyspark.sql import functions as F

from findmark.operators import judge, links, metrics, scoring
from findmark.plans import fixtures as X
from findmark.sources.scratch import empty, stored_by_series

SF = "/root/testdata/sf0.001"


@pytest.fixture
def steady(spark):
    """Plans as they are made, not as they are re-made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replies_are_checked_where_their_series_lie(steady, monkeypatch):
    """a task for each bucket; few small files went to a single task."""
    found, linked = X.kept(steady, SF)
    replies = stored_by_series(linked.select("series_uuid").distinct().withColumn("reply", F.lit("no JSON")), "replies")
    moved, check = [], judge.validate_matching

    def checked(rows):
        out = check(rows)
        moved.append(plan(out).count("Exchange"))
        return out

    monkeypatch.setattr(judge, "validate_matching", checked)
    judge.match_with_retries(judge.finding_lists(found), empty(steady, "series_uuid string, indication string"), "", lambda requests, attempt: replies, retries=1)
    assert moved == [0, 0]


def test_replies_to_reports_are_read_once(spark):
    """findings and failures come from one reading."""
    replies = [("s1", '{"findings": [{"text": "a"}, 5, {"text": "b"}]}'), ("s2", '{"findings": []}'), ("s3", "no"), ("s4", "{}")]
    read = judge.read_findings(spark.createDataFrame([(s, "gt", r) for s, r in replies], "series_uuid string, side string, reply string"))
    found, failed = judge.split_findings(read)
    assert sorted((r.finding_id, r.pos, r.text) for r in found.collect()) == [("s1_001", 0, "a"), ("s1_003", 2, "b")]
    assert sorted((r.series_uuid, r.reason, r.raw_response) for r in failed.collect()) == [("s3", "not JSON", "no"), ("s4", "no list of findings", "{}")]


def test_texts_of_a_group_are_taken_from_its_links(steady):
    """findings are not read once more, and single links take no part."""
    found, linked = X.kept(steady, SF)
    pairs = stored_by_series(scoring.linked_pairs(found, linked), "pairs")
    told = links.group_context(pairs, *scoring.sides(found))
    assert "base_" not in plan(told)
    plain = links.group_context(links.match_components(linked), *scoring.sides(found))
    keys = ["series_uuid", "pred_id", "gt_id", "same_group_pred", "same_group_gt"]
    rows = lambda df: sorted(map(str, df.select(*keys).collect()))
    assert rows(told) == rows(plain) and told.where("same_group_gt is not null").count() > 0


def test_requests_are_counted_without_lists(spark):
    """F2"""
    chunks = spark.createDataFrame([], "series_uuid string, chunk int, part string, pair_id int, pred_id string, gt_id string, p_text string, g_text string, same_group_pred array<string>, same_group_gt array<string>")
    assert "collect_list" not in plan(judge.attribute_requests(chunks, "").select("series_uuid", "chunk", "part", "n_pairs"))


def test_dimensions_are_counted_before_they_are_rows(spark):
    """a record is one row until it is summed up."""
    error = "array<struct<dimension:string,severity:string>>"
    rows = [("1", [("grade", "minor")], [("grade", "major")]), ("1", [("location", "minor"), ("odd", "major")], None), ("2", [], [])]
    out = metrics.attribute_breakdown(spark.createDataFrame(rows, f"series_uuid string, structured_errors {error}, text_errors {error}"), ["series_uuid"])
    got = {(r.series_uuid, r.dimension): (r.clean, r.minor, r.major, r.evaluated) for r in out.collect()}
    assert len(got) == 20 and got["1", "grade"] == (1, 0, 1, 2) and got["1", "location"] == (1, 1, 0, 2) and got["1", "extent"] == (2, 0, 0, 2) and got["2", "grade"] == (1, 0, 0, 1)
    assert plan(out).index("Generate") < plan(out).index("HashAggregate")
