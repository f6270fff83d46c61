"""Queries of sources and sinks, statistics, re-runs and the results explorer, with their SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmark import schema
from findmark.operators import explore as E
from findmark.operators import incremental as I
from findmark.operators import links, maintained, metrics, runs
from findmark.plans import core
from findmark.plans import fixtures as X
from findmark.plans.core import query
from findmark.sources import tables as S
from findmark.sources.scratch import new_path, stored


def _files(df: DataFrame, name: str) -> str:
    """Writes ``df(series_uuid, value)`` as packed text inputs; returns the folder."""
    path = new_path(df.sparkSession, name)
    S.pack(df, path)
    return path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("series_uuid"), "doc_id", "text", "lang")


@query("SELECT doc_id::VARCHAR AS series_uuid, CASE WHEN doc_id % 11 = 0 THEN '' ELSE regexp_replace(lang || ' report ' || doc_id, '^\\s+|\\s+$', '', 'g') END AS text, CASE WHEN doc_id % 11 = 0 THEN 'empty report' END AS reason FROM documents")
def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.concat(F.lit("  "), "lang", F.lit(" report "), "series_uuid", F.lit(" ")))
    good, bad = S.read_reports(spark, _files(_docs(spark, sf_dir).withColumn("value", text), "reports"), "gt")
    return good.select("series_uuid", "text", F.lit(None).cast("string").alias("reason")).union(bad.select("series_uuid", F.lit(""), "reason"))


@query("SELECT doc_id::VARCHAR AS series_uuid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'for ' || lang END AS indication FROM documents")
def read_indications(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" for "), "lang"))
    return S.read_indications(spark, _files(_docs(spark, sf_dir).withColumn("value", text), "indications"))


@query("SELECT doc_id::VARCHAR AS series_uuid, doc_id::VARCHAR || '_001' AS finding_id, lang AS text, 'abnormal' AS clinical_status, NULL AS reason FROM documents WHERE doc_id % 5 > 1 UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, 'not a list of findings' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, 'no finding' FROM documents WHERE doc_id % 5 = 1")
def read_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 5
    text = F.when(r == 0, '{"a": 1}').when(r == 1, "[]").otherwise(F.concat(F.lit('[{"text": "'), "lang", F.lit('", "clinical_status": "odd"}, 7]')))
    found, series, bad = S.read_findings(spark, _files(_docs(spark, sf_dir).withColumn("value", text), "findings"), "gt")
    null = F.lit(None).cast("string")
    empty = series.join(found.select("series_uuid").distinct(), "series_uuid", "left_anti")
    return found.select("series_uuid", "finding_id", "text", "clinical_status", null.alias("reason")).union(bad.select("series_uuid", null, null, null, "reason")).union(empty.select("series_uuid", null, null, null, F.lit("no finding")))


@query("SELECT series_uuid, finding_id, text, clinical_status FROM gt WHERE series_uuid::BIGINT % 4 <> 0 AND series_uuid NOT IN (SELECT series_uuid FROM gt WHERE pos = 3 AND k % 2 = 0)")
def adopt_gt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = X.findings(spark, sf_dir, "gt", ("k",)).withColumn("finding_id", F.when((F.col("pos") == 3) & (F.col("k") % 2 == 0), "").otherwise(F.col("finding_id")))
    there = X.series(spark, sf_dir).where("CAST(series_uuid AS bigint) % 4 = 0")
    return S.adopt_findings(source, there).select("series_uuid", "finding_id", "text", "clinical_status")


@query("SELECT DISTINCT doc_id::VARCHAR AS series_uuid, text FROM documents WHERE doc_id % 2 = 0")
def copy_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "copied")
    S.copy_inputs(_docs(spark, sf_dir).select("series_uuid", "text"), _docs(spark, sf_dir).where("doc_id % 2 = 0"), path)
    return spark.read.parquet(path)


@query("SELECT series_uuid, pred_id, gt_id FROM matches")
def write_stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, m = new_path(spark, "stage"), X.matches(spark, sf_dir).select("series_uuid", "pred_id", "gt_id")
    S.write_stage(m.limit(5), path, "earlier")
    S.write_stage(m, path, "this")
    return S.read_stage(spark, path, "this")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.scored(spark, sf_dir)


#: Fields of a tier in the summary; those by report are in the tiers of the whole set alone.
_TIER = (*metrics._FLAGS, "fn", "fp", "errors", "errors_per_finding", "recall", "precision")
_BY_REPORT = ("errors_per_report", "fn_per_report", "fp_per_report")
_SHARES = ("clean", "minor", "major", "evaluated", "clean_pct", "minor_pct", "major_pct")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the derived set, of which every fiftieth series counts as failed in scoring, too."""
    counts = stored(maintained.parts(*_records(spark, sf_dir)), "parts")
    series = X.series(spark, sf_dir)
    failures = series.where("CAST(series_uuid AS bigint) % 50 = 0").select(F.lit("scoring").alias("stage"), "series_uuid")
    return runs.summary(maintained.totals((counts, 1)), series, failures, _token_cost(spark, sf_dir))


def _values(summary: DataFrame) -> DataFrame:
    """Every number of the summary: ``path, value``, to six places."""
    tiers = summary.select(F.explode("tiers").alias("k", "v"))
    subsets = summary.select(F.explode("subsets").alias("s", "x")).select(F.concat(F.lit("subsets."), "s", F.lit(".")).alias("s"), "x.*")
    sub_tiers = subsets.select("s", F.explode("tiers").alias("k", "v"))
    dims = summary.select(F.explode("attribute_breakdown").alias("k", "v"))
    path = lambda *parts: F.concat(*(p if isinstance(p, str) else F.lit(p[0]) for p in parts))
    blocks = (
        (summary.select("metadata.*"), F.lit("metadata."), ("n_reports", "n_failed_reports", "total_gt_findings", "total_pred_findings", "token_cost"), ""),
        (summary.select("metadata.token_usage.*"), F.lit("metadata.token_usage."), ("calls", "prompt_tokens", "completion_tokens"), ""),
        (tiers, path(["tiers."], "k", ["."]), (*_TIER, *_BY_REPORT), "v."), (summary.select("muc_counts.*"), F.lit("muc_counts."), schema.OUTCOMES, ""), (dims, path(["attribute_breakdown."], "k", ["."]), _SHARES, "v."),
        (subsets, path("s", ["muc_counts."]), schema.OUTCOMES, "muc_counts."), (sub_tiers, path("s", ["tiers."], "k", ["."]), _TIER, "v."),
    )
    rows = [df.select(F.explode(F.array(*(F.struct(F.concat(at, F.lit(c)).alias("path"), F.round(F.col(x + c).cast("double"), 6).alias("value")) for c in fields))).alias("r")).select("r.*") for df, at, fields, x in blocks]
    return reduce(DataFrame.unionByName, rows).where("value is not null")


def _unpivoted(path: str, fields: tuple[str, ...], rows: str) -> str:
    """SQL of the same for ``rows``: the fields of each row under its path."""
    quoted = ", ".join(f'"{c}"' for c in fields)
    doubles = ", ".join(f'"{c}"::DOUBLE AS "{c}"' for c in fields)
    return f"SELECT path || name AS path, round(value, 6) AS value FROM (UNPIVOT (SELECT {path} AS path, {doubles} FROM {rows}) ON {quoted} INTO NAME name VALUE value)"


def _summary_sql() -> str:
    whole = re.sub(r"\b(gt_out|pred_out|contra|events|counts|rated|best|muc)\b", r"\1_all", core._scope_sql())
    by_report = ", ".join(f"{c.removesuffix('_per_report')} / (SELECT count(*) FROM series) AS {c}" for c in _BY_REPORT)
    told = f"""(SELECT (SELECT count(*) FROM series) AS n_reports, (SELECT count(*) FROM series WHERE series_uuid::BIGINT % 50 = 0) AS n_failed_reports, (SELECT count(DISTINCT (series_uuid, gt_id)) FROM records) + MIS AS total_gt_findings,
      (SELECT count(DISTINCT (series_uuid, pred_id)) FROM records) + SPU AS total_pred_findings, (SELECT token_cost FROM tokens) AS token_cost FROM muc_all)"""
    shares = "(SELECT *, clean / evaluated AS clean_pct, minor / evaluated AS minor_pct, major / evaluated AS major_pct FROM breakdown)"
    blocks = (
        ("'metadata.'", ("n_reports", "n_failed_reports", "total_gt_findings", "total_pred_findings", "token_cost"), told), ("'metadata.token_usage.'", ("calls", "prompt_tokens", "completion_tokens"), "tokens"),
        ("'tiers.' || tier || '.'", (*_TIER, *_BY_REPORT), f"(SELECT *, {by_report} FROM rated_all)"), ("'muc_counts.'", schema.OUTCOMES, "muc_all"), ("'attribute_breakdown.' || dimension || '.'", _SHARES, shares),
        ("'subsets.' || subset || '.muc_counts.'", schema.OUTCOMES, "muc"), ("'subsets.' || subset || '.tiers.' || tier || '.'", _TIER, "rated"),
    )
    return f"{core._scope_sql('subset')}{whole}, {core._BREAKDOWN_SQL}, tokens AS ({_TOKENS_SQL}) " + " UNION ALL ".join(_unpivoted(*b) for b in blocks)


_TOKENS_SQL = """SELECT count(*) AS calls, sum(a + b + c)::BIGINT AS prompt_tokens, sum(d)::BIGINT AS completion_tokens, round(sum(CASE m WHEN 0 THEN a * 0.5 + b * 0.5 + c * 0.5 * 1.25 + d * 2.0 WHEN 1 THEN a * 5.0 + b * 0.5 + c * 5.0 * 1.25 + d * 25.0 ELSE 0 END) / 1e6, 4) AS token_cost
  FROM (SELECT o % 3 AS m, k::BIGINT AS a, s::BIGINT AS b, n::BIGINT AS c, (k % 100)::BIGINT AS d FROM base)"""
_PRICES = (("small", 0.5, 2.0, None), ("large", 5.0, 25.0, 0.5))


def _token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = X.base(spark, sf_dir).selectExpr("CASE o % 3 WHEN 0 THEN ' Small' WHEN 1 THEN 'large' ELSE 'free' END AS model", "k AS uncached_input", "s AS cache_read", "CAST(n AS bigint) AS cache_write", "k % 100 AS output")
    return metrics.token_cost(usage, spark.createDataFrame(list(_PRICES), "model string, input double, output double, cached_input double"))


@query(_summary_sql())
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(_summary(spark, sf_dir))


@query(_summary_sql())
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, summary = new_path(spark, "summary"), _summary(spark, sf_dir)
    S.write_summary(summary, path)
    return _values(S.read_summary(spark, path, summary.schema))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, records, orphans = X.audited(spark, sf_dir)
    return E.report_index(core._by_report(records, orphans, X.series(spark, sf_dir)), found)


_INDEX_SQL = f"""{core._scope_sql('series_uuid')}, report_index AS (SELECT s.series_uuid, {", ".join(f"coalesce(max(r.errors) FILTER (r.tier = '{t}'), 0) AS {t}_errors" for t in schema.TIERS)}, {", ".join(f"coalesce(any_value(m.{c}), 0) AS muc_{c}" for c in schema.OUTCOMES)},
  any_value(v.significances) AS significances, any_value(v.categories) AS categories, any_value(v.comparisons) AS comparisons FROM series s LEFT JOIN rated r ON r.series_uuid = s.series_uuid LEFT JOIN muc m ON m.series_uuid = s.series_uuid
  LEFT JOIN (SELECT series_uuid, list_sort(list(DISTINCT clinical_significance)) AS significances, list_sort(list_distinct(flatten(list(list_transform(measurements, lambda x: x.category))))) AS categories, list_sort(coalesce(list(DISTINCT comparison) FILTER (comparison IS NOT NULL), [])) AS comparisons FROM findings GROUP BY 1) v ON v.series_uuid = s.series_uuid GROUP BY 1)"""
_LISTS = ("significances", "categories", "comparisons")
_FLAT_INDEX = "* REPLACE (" + ", ".join(f"coalesce(array_to_string({c}, ','), '') AS {c}" for c in _LISTS) + ")"


def _flat_index(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if c in _LISTS else c for c in df.columns))


@query(f"{_INDEX_SQL} SELECT {_FLAT_INDEX} FROM report_index")
def build_report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "index")
    _index(spark, sf_dir).write.parquet(path)
    return _flat_index(spark.read.parquet(path))


@query(f"{_INDEX_SQL} SELECT {_FLAT_INDEX} FROM report_index WHERE list_contains(significances, 'critical') AND list_contains(comparisons, 'new') AND muc_INC > 0 AND triage_errors BETWEEN 1 AND 3")
def filter_report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_index(E.filter_index(_index(spark, sf_dir), ["critical"], [], ["new"], ["INC"], "triage", 1, 3))


@query("SELECT 'extraction' AS stage, o_orderkey::VARCHAR AS series_uuid, 'late' AS reason FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'matching', o_orderkey::VARCHAR, 'odd' FROM orders WHERE o_orderkey % 10 = 0")
def failure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("series_uuid"))
    fails = lambda n, why: orders.select("series_uuid", F.when(F.col("o_orderkey") % n == 0, why).alias("reason"))
    return S.failure_table(("extraction", fails(9, "late")), ("matching", fails(10, "odd"))).drop("raw_response")


# Statistics


@query("SELECT side, count(*) AS total, count(*) FILTER (st = 0) AS processed, count(*) FILTER (st = 1) AS skipped, count(*) FILTER (st = 2) AS failed, coalesce(sum(n) FILTER (st = 0), 0)::BIGINT AS findings, round(coalesce(sum(n) FILTER (st = 0) / nullif(count(*) FILTER (st = 0), 0), 0.0), 6) AS findings_per_report FROM (SELECT series_uuid, side, series_uuid::BIGINT % 3 AS st, count(*) AS n FROM findings GROUP BY 1, 2) GROUP BY 1")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("series_uuid").cast("long") % 3
    state = F.when(r == 0, "processed").when(r == 1, "skipped").otherwise("failed")
    rows = X.both_sides(spark, sf_dir).groupBy("series_uuid", "side").agg(F.count("*").alias("n_findings")).withColumn("state", state)
    return core._rounded(metrics.extraction_stats(rows)).withColumn("findings_per_report", F.round("findings_per_report", 6))


@query("""SELECT count(*) FILTER (s % 13 <> 0) AS processed, count(*) FILTER (s % 13 = 0) AS failed, sum(n_matches)::BIGINT AS matches, sum(up)::BIGINT AS unmatched_pred, sum(ug)::BIGINT AS unmatched_gt, sum(s % 3)::BIGINT AS retries, count(*) FILTER (s % 3 = 2) AS fallbacks FROM (SELECT f.series_uuid::BIGINT AS s, coalesce(n, 0) AS n_matches, coalesce(up, 0) AS up, coalesce(ug, 0) AS ug
  FROM (SELECT DISTINCT series_uuid FROM findings) f LEFT JOIN (SELECT series_uuid, count(*) AS n FROM matches GROUP BY 1) m USING (series_uuid) LEFT JOIN (SELECT series_uuid, count(*) FILTER (side = 'pred') AS up, count(*) FILTER (side = 'gt') AS ug FROM orphans GROUP BY 1) o USING (series_uuid))""")
def matching_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.matches(spark, sf_dir).groupBy("series_uuid").agg(F.count("*").alias("n_matches"))
    o = X.orphans(spark, sf_dir).groupBy("series_uuid").agg(F.count_if(F.col("side") == "pred").alias("n_unmatched_pred"), F.count_if(F.col("side") == "gt").alias("n_unmatched_gt"))
    n = F.col("series_uuid").cast("long")
    rows = X.both_sides(spark, sf_dir).select("series_uuid").distinct().join(m, "series_uuid", "left").join(o, "series_uuid", "left").fillna(0)
    return metrics.matching_stats(rows.withColumn("failed", n % 13 == 0).withColumn("retries", n % 3).withColumn("validation_fallback", n % 3 == 2))


@query("SELECT count(*) FILTER (o_orderkey % 5 <> 0) AS processed, count(*) FILTER (o_orderkey % 5 = 0) AS failed, count(*) FILTER (o_orderkey % 5 > 1) AS non_empty, count(*) FILTER (o_orderkey % 5 = 1) AS empty FROM orders")
def indication_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("o_orderkey") % 5
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("series_uuid"), F.when(r == 1, "").when(r > 1, F.col("o_orderpriority")).alias("indication"))
    return metrics.indication_stats(rows)


@query(_TOKENS_SQL)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_cost(spark, sf_dir)


@query("SELECT (SELECT count(*) FROM series) AS expected, (SELECT count(DISTINCT series_uuid) FROM matches) AS scored, (SELECT count(*) FROM series WHERE series_uuid::BIGINT % 50 = 0) AS failed_in_scoring, (SELECT count(*) FROM series) - (SELECT count(DISTINCT series_uuid) FROM matches) AS missing, greatest(0, (SELECT count(*) FROM series) - (SELECT count(DISTINCT series_uuid) FROM matches) - (SELECT count(*) FROM series WHERE series_uuid::BIGINT % 50 = 0)) AS dropped_earlier")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = X.series(spark, sf_dir)
    return metrics.coverage(series, X.matches(spark, sf_dir), series.where("CAST(series_uuid AS bigint) % 50 = 0"))


# Sorts, limits and sets


@query("SELECT DISTINCT series_uuid FROM series ORDER BY 1 LIMIT 100")
def limit_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.limit_series(X.series(spark, sf_dir), 100)


@query("SELECT series_uuid FROM gt UNION SELECT series_uuid FROM pred UNION SELECT series_uuid FROM matches")
def report_ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report_ids(X.findings(spark, sf_dir, "gt"), X.findings(spark, sf_dir, "pred"), X.matches(spark, sf_dir))


@query("SELECT series_uuid FROM series ORDER BY 1")
def sorted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.series(spark, sf_dir).orderBy("series_uuid")


@query("SELECT series_uuid, pred_id, gt_id, array_to_string(list_sort(list_distinct(list_filter(g, lambda x: list_contains(p, x)))), ',') AS shared, array_to_string(list_sort(list_distinct(list_filter(g, lambda x: NOT list_contains(p, x)))), ',') AS gt_only FROM (SELECT series_uuid, pred_id, gt_id, list_transform(p_measurements, lambda m: m.category) AS p, list_transform(g_measurements, lambda m: m.category) AS g FROM pairs)")
def category_mismatch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = lambda c: F.transform(c, lambda m: m["category"])
    p, g = cats("p_measurements"), cats("g_measurements")
    text = lambda a, n: F.array_join(F.sort_array(a), ",").alias(n)
    return X.pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", text(F.array_intersect(g, p), "shared"), text(F.array_except(g, p), "gt_only"))


# Re-runs


@query("""SELECT series_uuid, side, finding_id, substr(sha256('{"clinical_status":"' || clinical_status || '","finding_id":"' || finding_id || '","laterality":' || coalesce('"' || laterality || '"', 'null') || '}'), 1, 16) AS fingerprint FROM findings""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.both_sides(spark, sf_dir).select("series_uuid", "side", "finding_id", I.fingerprint("laterality", "finding_id", "clinical_status").alias("fingerprint"))


@query("""SELECT series_uuid, substr(sha256('{"chunk_size":10,"model":"judge"}'), 1, 16) AS stamp FROM series""")
def stage_config_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.series(spark, sf_dir).withColumn("stamp", F.lit(I.stage_stamp({"model": "judge", "chunk_size": 10})))


@query("SELECT series_uuid, side, finding_id FROM findings WHERE series_uuid::BIGINT % 3 <> 1")
def invalidate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("series_uuid").cast("long") % 3
    rows = X.both_sides(spark, sf_dir).withColumn("stamp", F.when(r == 1, "old").when(r == 2, "new"))
    return I.usable_findings(rows, "new").select("series_uuid", "side", "finding_id")


@query("SELECT series_uuid, CASE WHEN s % 4 = 0 OR s % 5 = 0 OR s % 7 = 0 THEN 'todo' ELSE 'reuse' END AS state FROM (SELECT series_uuid, series_uuid::BIGINT AS s FROM series)")
def reuse_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("series_uuid").cast("long")
    inputs = X.series(spark, sf_dir).withColumn("fingerprint", F.sha1("series_uuid")).withColumn("config_hash", F.lit("c"))
    cache = inputs.where(n % 4 != 0).withColumn("config_hash", F.when(n % 5 == 0, "old").otherwise("c")).withColumn("validation_fallback", n % 7 == 0)
    reuse, todo = I.split_matching(inputs, cache, retry_degraded=True)
    return reuse.select("series_uuid", F.lit("reuse").alias("state")).union(todo.select("series_uuid", F.lit("todo")))


@query("SELECT series_uuid, CASE WHEN s % 4 = 0 OR s % 5 = 0 THEN 'todo' ELSE 'reuse' END AS state FROM (SELECT DISTINCT series_uuid, series_uuid::BIGINT AS s FROM matches)")
def reuse_text_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("series_uuid").cast("long")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "to", "pred_id", "gt_id"))), lambda x: F.concat_ws("|", x["pred_id"], x["gt_id"]))
    inputs = X.matches(spark, sf_dir).groupBy("series_uuid").agg(pairs.alias("pairs")).withColumn("fingerprint", F.sha1(F.array_join("pairs", ",")))
    cache = inputs.where(n % 4 != 0).withColumn("n", F.size("pairs")).withColumn("fingerprint", F.when(n % 5 == 0, "old").otherwise(F.col("fingerprint")))
    reuse, todo = I.split_text_errors(inputs, cache)
    return reuse.select("series_uuid", F.lit("reuse").alias("state")).union(todo.select("series_uuid", F.lit("todo")))


@query("SELECT series_uuid FROM series WHERE series_uuid::BIGINT % 8 <> 0")
def retry_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = I.retry_passes(X.series(spark, sf_dir), lambda left, n: left.where(F.col("series_uuid").cast("long") % (2 ** (n + 1)) != 0), 3)
    return done


# Explorer


@query("SELECT DISTINCT series_uuid FROM findings WHERE contains(lower(text), 'possible')")
def search_finding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.search_text(X.both_sides(spark, sf_dir), " POSSIBLE ")


@query("SELECT DISTINCT series_uuid FROM findings WHERE contains(lower(text), 'possible')")
def indexed_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a trigram index of all findings."""
    path = new_path(spark, "text-index")
    E.write_text_index(X.both_sides(spark, sf_dir), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return E.search_index(spark, path, " POSSIBLE ")


_SHOWN = """, shown AS (SELECT r.*, CASE WHEN inc_triggered OR coalesce(m, false) THEN 'INC' ELSE muc_category END AS shown FROM records r LEFT JOIN (SELECT series_uuid, pred_id, gt_id, bool_or(severity = 'major') AS m FROM all_errors GROUP BY 1, 2, 3) e USING (series_uuid, pred_id, gt_id)),
idx AS (SELECT series_uuid, 'gt' AS side, gt_id AS finding_id, any_value(gt_sig) AS sig, CASE max(CASE shown WHEN 'COR' THEN 3 WHEN 'PAR' THEN 2 ELSE 1 END) WHEN 3 THEN 'COR' WHEN 2 THEN 'PAR' ELSE 'INC' END AS category, count(*)::INT AS n, list(pred_sig) AS others, list(pred_sig) FILTER (shown = 'INC') AS inc_others FROM shown GROUP BY series_uuid, gt_id
  UNION ALL SELECT series_uuid, 'pred', pred_id, any_value(pred_sig), CASE max(CASE shown WHEN 'COR' THEN 3 WHEN 'PAR' THEN 2 ELSE 1 END) WHEN 3 THEN 'COR' WHEN 2 THEN 'PAR' ELSE 'INC' END, count(*)::INT, list(gt_sig), list(gt_sig) FILTER (shown = 'INC') FROM shown GROUP BY series_uuid, pred_id
  UNION ALL SELECT series_uuid, side, finding_id, clinical_significance, CASE side WHEN 'gt' THEN 'MIS' ELSE 'SPU' END, 0, [], [] FROM orphans)"""


@query(f"{_SHOWN} SELECT series_uuid, side, finding_id, category, n FROM idx")
def match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_index(*_records(spark, sf_dir)).select("series_uuid", "side", "finding_id", "category", F.size("counterparts").alias("n"))


@query(f"""{_SHOWN} SELECT series_uuid, side, finding_id, category FROM (SELECT i.*, f.clinical_status, {X._subset_sql('f.')} AS subsets FROM idx i JOIN findings f USING (series_uuid, side, finding_id))
  WHERE list_contains(subsets, 'measurement') AND ((category = 'MIS' AND sig IN ('critical', 'urgent')) OR (category = 'SPU' AND sig IN ('critical', 'urgent') AND clinical_status <> 'normal') OR (len(inc_others) > 0 AND (sig IN ('critical', 'urgent') OR list_has_any(inc_others, ['critical', 'urgent']))))""")
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, records, orphans = X.audited(spark, sf_dir)
    return E.filter_findings(E.match_index(records, orphans, found), None, "measurement", "triage").select("series_uuid", "side", "finding_id", "category")


@query(f"""{_SHOWN} SELECT series_uuid, side, finding_id, CASE WHEN side = 'gt' AND ins THEN (category NOT IN ('COR', 'PAR'))::INT END AS fn, CASE WHEN side = 'gt' AND NOT ins THEN (category = 'INC' AND list_has_any(others, ['critical', 'urgent']))::INT WHEN side = 'pred' AND category = 'SPU' AND clinical_status <> 'normal' AND ins THEN 1 END AS fp,
  CASE WHEN side = 'gt' AND ins THEN (category IN ('COR', 'PAR'))::INT END AS recall_hit, CASE WHEN side = 'pred' AND ins AND NOT (category = 'SPU' AND clinical_status = 'normal') THEN (category IN ('COR', 'PAR'))::INT END AS precision_hit
  FROM (SELECT i.*, f.clinical_status, sig IN ('critical', 'urgent') AS ins FROM idx i JOIN findings f USING (series_uuid, side, finding_id))""")
def finding_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, records, orphans = X.audited(spark, sf_dir)
    return E.finding_impact(E.match_index(records, orphans, found), None, "triage")


@query(f""", {core._BREAKDOWN_SQL} SELECT series_uuid, pred_id, gt_id, dimension, CASE WHEN major THEN 'major' WHEN major IS NOT NULL THEN 'minor' ELSE 'clean' END AS severity
  FROM (SELECT series_uuid, pred_id, gt_id, dimension FROM records CROSS JOIN {core._DIMS}) LEFT JOIN worst USING (series_uuid, pred_id, gt_id, dimension)""")
def pair_error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pair_error_table(X.score_pairs(spark, sf_dir)).drop("reasoning")


@query(f"{core._scope_sql()} SELECT outcome, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM (UNPIVOT muc ON COR, PAR, INC, MIS, SPU INTO NAME outcome VALUE n)")
def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core._rounded(E.outcome_distribution(metrics.muc_counts(*_records(spark, sf_dir)))).withColumn("pct", F.round("pct", 6))


@query(f", {core._BREAKDOWN_SQL} SELECT dimension, severity, n, round(100 * n / evaluated, 6) AS pct FROM (UNPIVOT breakdown ON clean, minor, major INTO NAME severity VALUE n)")
def attribute_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.attribute_distribution(metrics.attribute_breakdown(X.score_pairs(spark, sf_dir))).withColumn("pct", F.round("pct", 6))


_WHOLE = re.sub(r"\b(gt_out|pred_out|contra|events|counts|rated|best|muc)\b", r"\1_all", core._scope_sql())
_ROW = """round(errors_per_finding, 6) AS errors_per_finding, fn, fp, findings_at_stake, round(100 * recall, 6) AS recall_pct, round(100 * "precision", 6) AS precision_pct, COR, PAR, INC, MIS, SPU"""


@query(f"{core._scope_sql('subset')}{_WHOLE} SELECT subset AS scope, {_ROW} FROM rated JOIN muc USING (subset) WHERE tier = 'significant' UNION ALL SELECT 'overall', {_ROW} FROM rated_all, muc_all WHERE tier = 'significant'")
def subset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, orphans = _records(spark, sf_dir)
    pct = lambda c: F.round(100 * F.col(c), 6).alias(f"{c}_pct")
    fields = (F.round("errors_per_finding", 6).alias("errors_per_finding"), "fn", "fp", "findings_at_stake", pct("recall"), pct("precision"), *schema.OUTCOMES)
    whole = metrics.tier_metrics(records, orphans).where("tier = 'significant'").crossJoin(metrics.muc_counts(records, orphans)).select(F.lit("overall").alias("scope"), *fields)
    sub_r, sub_o = metrics.by_subset(records, orphans)
    rows = metrics.tier_metrics(sub_r, sub_o, ["subset"]).where("tier = 'significant'").join(metrics.muc_counts(sub_r, sub_o, ["subset"]), "subset")
    return whole.unionByName(rows.select(F.col("subset").alias("scope"), *fields))


@query("SELECT series_uuid, side, finding_id, CASE side WHEN 'gt' THEN 'GT' ELSE 'Pred' END || lpad(pos::VARCHAR, 2, '0') AS label FROM findings")
def finding_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.both_sides(spark, sf_dir).select("series_uuid", "side", "finding_id", E.label(F.col("finding_id"), F.col("side")).alias("label"))


@query(f"""{core._scope_sql('series_uuid')} SELECT series_uuid, tier, CASE WHEN recall_total > 0 THEN printf('%.1f%% (%d / %d)', 100.0 * recall_hits / recall_total, recall_hits, recall_total) ELSE '—' END AS label FROM rated""")
def tier_rate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, orphans = _records(spark, sf_dir)
    return metrics.tier_metrics(records, orphans, ["series_uuid"]).select("series_uuid", "tier", E.rate_label("recall_hits", "recall_total").alias("label"))
