"""Tables kept in buckets by series: what is done within series moves no row again."""

import pytest
from pyspark.sql import functions as F

from findmark.operators import explore, links, metrics, scoring
from findmark.plans import fixtures as X
from findmark.plans import results
from findmark.sources.scratch import stored_by_series

SF = "/root/testdata/sf0.001"


@pytest.fixture
def steady(spark):
    """Plans as they are made, not as they are re-made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pairs_and_orphans_stay_in_place(steady):
    found, linked = X.kept(steady, SF)
    assert exchanges(links.pair_findings(linked, *scoring.sides(found))) == 0
    assert exchanges(scoring.orphans(found, linked)) == 0


def test_links_move_once(steady):
    found, linked = X.kept(steady, SF)
    assert exchanges(scoring.linked_pairs(found, linked)) <= 1  # after the step in Python


def test_counts_by_series_move_once(steady):
    records, orphans = X.scored(steady, SF)
    assert exchanges(metrics.tier_counts(records, orphans, ["series_uuid"])) <= 1  # the counts of a series
    assert exchanges(metrics.muc_counts(records, orphans, ["series_uuid"])) <= 1
    assert exchanges(metrics.gt_outcomes(records, ["series_uuid"])) == 0


@pytest.mark.parametrize("name", ["finding_impact", "filter_findings"])
def test_findings_are_joined_in_place(steady, name):
    assert exchanges(getattr(results, name)(steady, SF)) == 0


def test_an_index_with_findings_gives_the_same(spark):
    found, records, orphans = X.audited(spark, SF)
    bare, full = explore.match_index(records, orphans), explore.match_index(records, orphans, found)
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert rows(explore.finding_impact(bare, found, "significant")) == rows(explore.finding_impact(full, None, "significant"))
    for subset, tier in (("comparison", "critical"), (None, "all")):
        assert rows(explore.filter_findings(bare, found, subset, tier)) == rows(explore.filter_findings(full, None, subset, tier))


def test_kept_table_has_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 17).cast("string").alias("series_uuid"), "id").union(spark.sql("SELECT CAST(NULL AS string), 1000L"))
    kept = stored_by_series(rows, "rows")
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, rows.collect()))
    assert kept.count() == 1001
