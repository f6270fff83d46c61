"""Steps of the audit whose rows and lists must not grow with the findings."""

from findmark import schema
from findmark.operators import explore, links, metrics, scoring
from findmark.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiers_are_counted_without_lists_and_from_few_kinds(spark):
    records, orphans = X.scored(spark, SF)
    for keys in ([], ["series_uuid"]):
        counts = plan(metrics.tier_counts(records, orphans, keys))
        assert "collect_set" not in counts and "SortAggregate" not in counts and "ObjectHashAggregate" not in counts
    kinds = metrics._events(records, orphans, [])
    assert kinds.distinct().count() < 200 < kinds.count()


def test_significance_outside_the_tiers_counts_nowhere(spark):
    record = "series_uuid string, gt_id string, pred_id string, category string, gt_sig string, pred_sig string"
    orphan = "series_uuid string, side string, finding_id string, clinical_status string, clinical_significance string"
    records = spark.createDataFrame([("1", "g", "p", "INC", "odd", "urgent"), ("1", "h", "q", "COR", "critical", None), ("1", "i", "r", None, "notable", "odd")], record)
    orphans = spark.createDataFrame([("1", "gt", "x", "abnormal", None), ("1", "pred", "y", None, "critical")], orphan)
    rows = {r["tier"]: r for r in metrics.tier_counts(records, orphans).collect()}
    got = {t: tuple(rows[t][f] for f in metrics._FLAGS) for t in schema.TIERS}
    # the flags in order: fn_mis, fn_inc, fp_spu, fp_inc, at stake, recall hits and total, precision hits and total
    assert got == {"all": (0, 0, 1, 1, 4, 1, 2, 0, 2), "significant": (0, 0, 1, 1, 4, 1, 2, 0, 2), "triage": (0, 0, 1, 1, 3, 1, 1, 0, 2), "critical": (0, 0, 1, 0, 2, 1, 1, 0, 1)}


def test_a_pair_does_not_hold_the_list_of_all_givers(spark):
    size, none = [(1.0, "mm", "size")], []
    rows = [("1", f"p{i}", "g", m) for i, m in enumerate((size, none, size))] + [("1", "p0", "h", size), ("1", "p1", "h", none), ("1", "p2", "i", size), ("1", "p3", "j", None)]
    rows.append(("1", "p0", "k", size))
    pairs = spark.createDataFrame([*rows, rows[-1]], "series_uuid string, pred_id string, gt_id string, p_measurements array<struct<value:double,unit:string,category:string>>")
    out = links.size_given_elsewhere(pairs)
    got = sorted({(r["gt_id"], r["pred_id"], r["size_elsewhere"]) for r in out.collect()})
    assert got == [("g", "p0", True), ("g", "p1", True), ("g", "p2", True), ("h", "p0", False), ("h", "p1", True), ("i", "p2", False), ("j", "p3", False), ("k", "p0", False)]
    assert "collect_set" not in plan(out)


def test_windows_and_anti_joins_sort_no_texts_or_measurements(spark):
    found, linked = X.kept(spark, SF)
    rows = scoring.with_structured_errors(scoring.linked_pairs(found, linked)).select("series_uuid", "structured_errors", "needs_judge")
    orphans = scoring.orphans(found, linked).select("series_uuid", "finding_id", "subsets")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        rows, orphans = (df._jdf.queryExecution().optimizedPlan().toString() for df in (rows, orphans))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "p_text" not in rows[: rows.rindex("Window [")]
    assert "measurements" not in orphans[: orphans.index("Join LeftAnti")]


def test_an_index_has_each_text_once(spark, tmp_path):
    rows = [(f"s{i % 50}", "gt" if i % 2 else "pred", f"{i}", ("Cyst", "cyst", "effusion", None)[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "series_uuid string, side string, finding_id string, text string")
    path = str(tmp_path / "index")
    explore.write_text_index(df, path, 4)
    assert spark.read.parquet(f"{path}/postings").count() == 2 + 6  # trigrams of two different texts
    for text in ("cyst", "FUS", "y", "", "cysts"):
        found, scan = explore.search_index(spark, path, text), explore.search_text(df.where("text is not null"), text)
        assert sorted(r.series_uuid for r in found.collect()) == sorted(r.series_uuid for r in scan.collect()), text
