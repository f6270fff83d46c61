"""Queries over the derived findings: normalisation, joins, comparators, outcomes and aggregations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmark import schema
from findmark.functions import comparators as C
from findmark.functions import normalize as N
from findmark.functions import outcomes as K
from findmark.operators import links, metrics, scoring
from findmark.plans import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; ``sql`` follows the common table expressions."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = f"{X.SQL}\n{sql}"
        return f

    return add


# Rows as they come, before normalisation: spellings, blanks and unknown values.
_RAW = {
    "clinical_status": "CASE k % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'Normal' WHEN 2 THEN 'abnormal' WHEN 3 THEN 'unclear' END",
    "clinical_significance": "CASE k % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'urgent' WHEN 2 THEN 'notable' WHEN 3 THEN 'routine' WHEN 4 THEN 'Critical' WHEN 5 THEN 'low' END",
    "comparison": "CASE k % 8 WHEN 0 THEN 'stable' WHEN 1 THEN 'new' WHEN 2 THEN ' new' WHEN 3 THEN 'resolved' WHEN 4 THEN 'worsening' WHEN 5 THEN 'same' END",
    "laterality": "CASE k % 6 WHEN 0 THEN ' Left ' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'bilateral' WHEN 3 THEN '' WHEN 4 THEN 'midline' END",
    "unit": "CASE s % 9 WHEN 0 THEN '%' WHEN 1 THEN ' Millimeters' WHEN 2 THEN 'CM3' WHEN 3 THEN 'minutes' WHEN 4 THEN '' WHEN 5 THEN 'cc' WHEN 6 THEN 'Centimetre' WHEN 7 THEN 'mm' END",
}
_RAW_SQL = "SELECT o::VARCHAR AS series_uuid, n AS pos, " + ", ".join(f"{e} AS {c}" for c, e in _RAW.items()) + " FROM base"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.base(spark, sf_dir).selectExpr("CAST(o AS string) AS series_uuid", "n AS pos", *(f"{e} AS {c}" for c, e in _RAW.items()), "k", "s", "q")


def _in(c: str, values: tuple[str, ...], default: str) -> str:
    return f"CASE WHEN {c} IN ({', '.join(repr(v) for v in values)}) THEN {c} ELSE {default} END"


@query(f"""SELECT series_uuid, pos, {_in('clinical_status', schema.STATUS, "'abnormal'")} AS clinical_status, {_in('clinical_significance', schema.SIGNIFICANCE, "'routine'")} AS clinical_significance,
  {_in('comparison', schema.COMPARISON, 'NULL')} AS comparison, {_in('lower(trim(laterality))', schema.LATERALITY, 'NULL')} AS laterality FROM ({_RAW_SQL})""")
def normalize_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("series_uuid", "pos", N.status("clinical_status").alias("clinical_status"), N.significance("clinical_significance").alias("clinical_significance"), N.comparison("comparison").alias("comparison"), N.laterality("laterality").alias("laterality"))


_UNIT_SQL = "nullif(CASE lower(trim(unit)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in schema.UNIT_ALIASES.items()) + " ELSE lower(trim(unit)) END, '')"


@query(f"SELECT series_uuid, pos, {_UNIT_SQL} AS unit FROM ({_RAW_SQL})")
def normalize_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("series_uuid", "pos", N.unit("unit").alias("unit"))


_JSON = {
    "spark": """'[' || concat_ws(',', '{"value": ' || CAST(k AS string) || ', "unit": "CM", "category": "size"}', CASE WHEN k % 3 = 0 THEN '{"value": "' || CAST(s AS string) || '", "category": "odd"}' END,
      CASE WHEN k % 4 = 0 THEN '17' END, CASE WHEN k % 5 = 0 THEN '{"value": "many", "category": "count"}' END, CASE WHEN k % 7 = 0 THEN '{"value": 3}' END) || ']'""",
}


@query(f"""SELECT series_uuid, pos, unnest(CASE WHEN k % 3 = 0 THEN [1, 2] ELSE [1] END) AS i, unnest(CASE WHEN k % 3 = 0 THEN [k::DOUBLE, s::DOUBLE] ELSE [k::DOUBLE] END) AS value,
  unnest(CASE WHEN k % 3 = 0 THEN ['cm', NULL] ELSE ['cm'] END) AS unit, unnest(CASE WHEN k % 3 = 0 THEN ['size', 'other'] ELSE ['size'] END) AS category FROM (SELECT o::VARCHAR AS series_uuid, n AS pos, k, s FROM base)""")
def normalize_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.try_parse_json(F.expr(_JSON["spark"])).cast("array<variant>")
    rows = _raw(spark, sf_dir).select("series_uuid", "pos", F.posexplode(N.measurements(items)).alias("i", "m"))
    return rows.select("series_uuid", "pos", (F.col("i") + 1).alias("i"), "m.value", "m.unit", "m.category")


@query("""SELECT series_uuid, series_uuid || '_' || lpad(i::VARCHAR, 3, '0') AS finding_id, text FROM (SELECT o::VARCHAR AS series_uuid, unnest(range(1, m + 1)) AS i, 'slot ' || unnest(range(1, m + 1)) AS text FROM (SELECT o, max(n) AS m FROM base GROUP BY 1)) WHERE i % 4 <> 2""")
def number_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.base(spark, sf_dir).groupBy(F.col("o").cast("string").alias("series_uuid")).agg(F.max("n").alias("m"))
    slot = "transform(sequence(1, m), i -> CASE WHEN i % 4 = 2 THEN '\"loose\"' ELSE '{\"text\": \"slot ' || CAST(i AS string) || '\"}' END)"
    raw = orders.select("series_uuid", F.expr(f"'[' || concat_ws(',', {slot}) || ']'").alias("reply"))
    slots = raw.select("series_uuid", F.posexplode(F.try_parse_json("reply").cast("array<variant>")).alias("pos", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return slots.select("series_uuid", N.finding_id("series_uuid", "pos").alias("finding_id"), F.try_variant_get("v", "$.text", "string").alias("text"))


@query("SELECT series_uuid, side, finding_id, coalesce(CASE WHEN k % 9 = 4 THEN NULL ELSE text END, '') AS text, clinical_status, len(measurements)::INT AS n_measurements FROM gt")
def project_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.findings(spark, sf_dir, "gt", ("k",)).withColumn("text", F.when(F.col("k") % 9 != 4, F.col("text")))
    none = F.array().cast(f"array<{schema.MEASUREMENT}>")
    out = raw.select("series_uuid", "side", "finding_id", F.coalesce("text", F.lit("")).alias("text"), "clinical_status", F.coalesce("measurements", none).alias("measurements"))
    return out.withColumn("n_measurements", F.size("measurements")).drop("measurements")


@query("SELECT series_uuid, side, finding_id, text, clinical_status, laterality FROM findings")
def matching_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.both_sides(spark, sf_dir).select("series_uuid", "side", "finding_id", "text", "clinical_status", "laterality")


@query(f"SELECT series_uuid, pred_id, gt_id, {X.NEEDS_JUDGE} AS needs_judge FROM pairs")
def needs_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", N.needs_judge("p_clinical_status", "g_clinical_status", "p_text", "g_text").alias("needs_judge"))


@query("SELECT series_uuid, finding_id, clinical_status IS DISTINCT FROM 'normal' AS unsupported FROM orphans WHERE side = 'pred'")
def is_unsupported_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orphans(spark, sf_dir).where("side = 'pred'").select("series_uuid", "finding_id", N.is_unsupported().alias("unsupported"))


@query("SELECT series_uuid, finding_id, (clinical_status IS DISTINCT FROM 'normal' OR clinical_significance IS DISTINCT FROM 'routine') AS missed FROM orphans WHERE side = 'gt'")
def is_missed_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orphans(spark, sf_dir).where("side = 'gt'").select("series_uuid", "finding_id", N.is_missed().alias("missed"))


@query(f"SELECT series_uuid, finding_id, unnest({X._subset_sql('')}) AS subset FROM gt")
def assign_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.findings(spark, sf_dir, "gt").select("series_uuid", "finding_id", F.explode(N.subsets()).alias("subset"))


@query("SELECT tier, clinical_significance, list_contains(pool, clinical_significance) AS inside, count(*) AS n FROM gt, tier GROUP BY 1, 2, 3")
def tier_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.findings(spark, sf_dir, "gt").select("clinical_significance", F.explode(N.tiers()).alias("t"))
    return rows.groupBy("t.tier", "clinical_significance", F.array_contains("t.pool", F.col("clinical_significance")).alias("inside")).agg(F.count("*").alias("n"))


@query("""SELECT series_uuid, pred_id, gt_id, dimension, severity, reasoning FROM (SELECT series_uuid, pred_id, gt_id, CASE k % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'colour' ELSE 'laterality' END AS dimension,
  CASE s % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'Major' ELSE 'major' END AS severity, CASE WHEN s % 2 = 0 THEN 'seen' ELSE '' END AS reasoning FROM matches) WHERE dimension = 'location' AND severity IN ('major', 'minor')""")
def normalize_judge_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "array(named_struct('dimension', CASE k % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'colour' ELSE 'laterality' END, 'severity', CASE s % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'Major' ELSE 'major' END, 'reasoning', CASE WHEN s % 2 = 0 THEN 'seen' END))"
    return X.matches(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", F.inline(N.judge_errors(F.expr(raw))))


# Joins and graph


@query("SELECT DISTINCT series_uuid FROM gt WHERE series_uuid IN (SELECT series_uuid FROM pred) AND series_uuid IN (SELECT series_uuid FROM matches) AND series_uuid IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderpriority < '4')")
def shared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority < '4'").select(F.col("o_orderkey").cast("string").alias("series_uuid"))
    return links.shared_series(X.findings(spark, sf_dir, "gt"), X.findings(spark, sf_dir, "pred"), X.matches(spark, sf_dir), allowed=allowed)


@query("SELECT series_uuid, pred_id, gt_id, p_text, g_text, p_clinical_status, g_clinical_status FROM pairs")
def pair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", "p_text", "g_text", "p_clinical_status", "g_clinical_status")


@query("SELECT s.series_uuid, coalesce(i.indication, '') AS indication FROM series s LEFT JOIN (SELECT o_orderkey::VARCHAR AS series_uuid, o_orderpriority AS indication FROM orders WHERE o_orderkey % 3 = 0) i ON s.series_uuid = i.series_uuid")
def attach_indication(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("series_uuid"), F.col("o_orderpriority").alias("indication"))
    return links.attach_indication(X.series(spark, sf_dir), known)


@query("SELECT series_uuid FROM series WHERE series_uuid NOT IN (SELECT series_uuid FROM matches WHERE k % 2 = 0)")
def todo_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.todo(X.series(spark, sf_dir), X.matches(spark, sf_dir).where("k % 2 = 0"), ["series_uuid"])


@query("SELECT series_uuid, side, finding_id FROM orphans")
def orphan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orphans(spark, sf_dir).select("series_uuid", "side", "finding_id")


@query("SELECT series_uuid, pred_id, gt_id, size_elsewhere FROM elsewhere")
def size_given_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.size_given_elsewhere(X.pairs(spark, sf_dir)).select("series_uuid", "pred_id", "gt_id", "size_elsewhere")


@query("SELECT l.series_uuid, pred_id, gt_id, array_to_string(group_preds, ',') AS group_preds, array_to_string(group_gts, ',') AS group_gts FROM linked l JOIN groups g ON l.series_uuid = g.series_uuid AND l.component = g.component")
def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.match_groups(X.matches(spark, sf_dir)).select("series_uuid", "pred_id", "gt_id", F.array_join("group_preds", ",").alias("group_preds"), F.array_join("group_gts", ",").alias("group_gts"))


@query("""SELECT l.series_uuid, l.pred_id, l.gt_id, string_agg(f.text, '|' ORDER BY f.finding_id) FILTER (f.side = 'pred' AND f.finding_id <> l.pred_id) AS same_group_pred, string_agg(f.text, '|' ORDER BY f.finding_id) FILTER (f.side = 'gt' AND f.finding_id <> l.gt_id) AS same_group_gt
  FROM linked l JOIN members m ON l.series_uuid = m.series_uuid AND l.component = m.component JOIN findings f ON f.series_uuid = m.series_uuid AND f.side = m.side AND f.finding_id = m.finding_id GROUP BY 1, 2, 3""")
def group_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.group_context(links.match_components(X.matches(spark, sf_dir)), X.findings(spark, sf_dir, "pred"), X.findings(spark, sf_dir, "gt"))
    return out.select("series_uuid", "pred_id", "gt_id", F.array_join("same_group_pred", "|").alias("same_group_pred"), F.array_join("same_group_gt", "|").alias("same_group_gt"))


@query("SELECT series_uuid, pred_id, gt_id, p_group, g_group FROM grouped")
def group_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.grouped_pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", "p_group", "g_group")


@query("SELECT series_uuid, list_aggregate(list_sort(list(DISTINCT finding_id)), 'string_agg', ',') AS stale_ids FROM (SELECT series_uuid, CASE WHEN pos = 7 THEN finding_id || 'x' ELSE finding_id END AS finding_id FROM orphans) WHERE finding_id LIKE '%x' GROUP BY 1")
def stale_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = X.orphans(spark, sf_dir).withColumn("finding_id", F.when(F.col("pos") == 7, F.concat("finding_id", F.lit("x"))).otherwise(F.col("finding_id")))
    return links.stale_ids(named, X.both_sides(spark, sf_dir)).select("series_uuid", F.array_join("stale_ids", ",").alias("stale_ids"))


@query("SELECT DISTINCT a.series_uuid, a.gt_id AS finding_id, b.gt_id AS sibling_id FROM matches a JOIN matches b ON a.series_uuid = b.series_uuid AND a.pred_id = b.pred_id AND a.gt_id <> b.gt_id")
def two_hop_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.siblings(X.matches(spark, sf_dir))


@query("""SELECT series_uuid, component, pred_id, gt_id FROM linked WHERE (series_uuid, component) IN (SELECT (l.series_uuid, l.component) FROM linked l JOIN gt ON l.series_uuid = gt.series_uuid AND l.gt_id = gt.finding_id WHERE gt.pos = 2)""")
def component_of_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = X.findings(spark, sf_dir, "gt").where("pos = 2").select("series_uuid", "side", "finding_id")
    return links.component_of(links.match_components(X.matches(spark, sf_dir)), chosen).select("series_uuid", "component", "pred_id", "gt_id")


# Comparators


def _flat(rows: DataFrame, errors: str = "errors") -> DataFrame:
    """One row per pair, dimension and severity, with the number of errors."""
    return rows.select("series_uuid", "pred_id", "gt_id", F.explode(errors).alias("e")).groupBy("series_uuid", "pred_id", "gt_id", "e.dimension", "e.severity").agg(F.count("*").alias("n"))


_FLAT_SQL = "SELECT series_uuid, pred_id, gt_id, dimension, severity, count(*) AS n FROM structured {w} GROUP BY 1, 2, 3, 4, 5"


@query(_FLAT_SQL.format(w="WHERE dimension = 'clinical_status'"))
def status_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.pairs(spark, sf_dir).withColumn("e", C.status_conflict(F.col("p_clinical_status"), F.col("g_clinical_status"))).where("e IS NOT NULL")
    return _flat(rows.withColumn("errors", F.array("e")))


@query("SELECT series_uuid, pred_id, gt_id, 0 AS n FROM pairs WHERE p_clinical_status = 'normal' AND g_clinical_status = 'normal'")
def both_normal_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_structured_errors(X.grouped_pairs(spark, sf_dir)).where("p_clinical_status = 'normal' AND g_clinical_status = 'normal'")
    return rows.select("series_uuid", "pred_id", "gt_id", F.size("structured_errors").alias("n"))


@query("""SELECT series_uuid, pred_id, gt_id, CASE WHEN p_laterality IS NOT DISTINCT FROM g_laterality OR g_laterality IS NULL OR p_group IS NOT DISTINCT FROM g_group OR (p_group IS NULL AND g_group IS NOT DISTINCT FROM 'bilateral') THEN NULL
  WHEN p_clinical_significance = 'routine' AND g_clinical_significance = 'routine' THEN 'minor' ELSE 'major' END AS severity FROM grouped""")
def laterality_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    severity = C.laterality_severity(c("p_laterality"), c("g_laterality"), c("p_group"), c("g_group"), c("p_clinical_significance"), c("g_clinical_significance"))
    return X.grouped_pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", severity.alias("severity"))


@query("""SELECT series_uuid, pred_id, gt_id, CASE WHEN p_comparison IS NOT DISTINCT FROM g_comparison THEN NULL WHEN p_comparison IS NULL OR g_comparison IS NULL THEN 'minor'
  WHEN (p_comparison IN ('new', 'worsening')) <> (g_comparison IN ('new', 'worsening')) THEN 'major' ELSE 'minor' END AS severity FROM pairs""")
def comparison_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", C.comparison_severity(F.col("p_comparison"), F.col("g_comparison")).alias("severity"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of single measurements over all slots: values, units and zeros of many kinds."""
    unit = "CASE {x} % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'CM' WHEN 2 THEN 'ml' WHEN 3 THEN 'l' WHEN 4 THEN 'beats' END"
    m = lambda v, x: f"named_struct('value', CAST({v} AS double), 'unit', {unit.format(x=x)}, 'category', 'size')"
    return X.base(spark, sf_dir).selectExpr("CAST(o AS string) AS series_uuid", "n AS pos", f"{m('k % 60 - 20', 'k')} AS pm", f"{m('s % 50 - 20', 's')} AS gm")


def _grid_sql(expr: str) -> str:
    unit = "CASE {x} % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'CM' WHEN 2 THEN 'ml' WHEN 3 THEN 'l' WHEN 4 THEN 'beats' END"
    m = lambda v, x: f"{{'value': ({v})::DOUBLE, 'unit': {unit.format(x=x)}}}"
    return f"SELECT series_uuid, pos, {expr} FROM (SELECT o::VARCHAR AS series_uuid, n AS pos, {m('k % 60 - 20', 'k')} AS pm, {m('s % 50 - 20', 's')} AS gm FROM base)"


@query(_grid_sql(f"{X._CANON.format(m='pm')} AS value"))
def canonical_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("series_uuid", "pos", C.canonical(F.col("pm")).alias("value"))


def _grid_query(name: str, builder) -> None:
    category = name.removeprefix("compare_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _grid(spark, sf_dir).select("series_uuid", "pos", builder(F.col("pm"), F.col("gm")).alias("severity"))

    query(_grid_sql(f"{X.measurement_severity_sql(repr(category))} AS severity"), name)(run)


for _name, _builder in C.COMPARATORS.items():
    _grid_query(f"compare_{_name}", _builder)


@query(_grid_sql("CASE WHEN gm.value = 0 THEN pm.value <> 0 ELSE abs(pm.value - gm.value) / abs(gm.value) > 0.2 END AS exceeds"))
def relative_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("series_uuid", "pos", C.exceeds(F.col("pm.value"), F.col("gm.value"), 0.2).alias("exceeds"))


@query("SELECT series_uuid, pred_id, gt_id, list_aggregate(list_transform(pa, lambda m: m.category), 'string_agg', ',') AS categories FROM aligned WHERE len(pa) > 0")
def align_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(C.align_categories(F.col("p_measurements"), F.col("g_measurements")), lambda m: m["category"])
    return X.pairs(spark, sf_dir).where("size(p_measurements) > 0").select("series_uuid", "pred_id", "gt_id", F.array_join(own, ",").alias("categories"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.grouped_pairs(spark, sf_dir)
    return rows.withColumn("errors", C.measurement_errors(F.col("p_measurements"), F.col("g_measurements"), F.col("size_elsewhere")))


@query("SELECT series_uuid, pred_id, gt_id, cat, count(*) AS n FROM lack GROUP BY 1, 2, 3, 4")
def measurement_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", F.explode("errors").alias("e")).where("e.pred_value IS NULL AND e.reasoning LIKE '% is left out' AND e.reasoning NOT LIKE 'one more%'")
    return rows.groupBy("series_uuid", "pred_id", "gt_id", F.substring_index("e.reasoning", " ", 1).alias("cat")).agg(F.count("*").alias("n"))


@query("SELECT series_uuid, pred_id, gt_id, severity, count(*) AS n FROM measured GROUP BY 1, 2, 3, 4")
def measurement_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_measured(spark, sf_dir)).drop("dimension")


@query("SELECT series_uuid, round(min(cost), 6) AS cost FROM (SELECT series_uuid, sum(abs(a - b)) AS cost FROM (SELECT o::VARCHAR AS series_uuid, row_number() OVER (PARTITION BY o ORDER BY q) AS r, q AS a FROM base) JOIN (SELECT o::VARCHAR AS series_uuid, row_number() OVER (PARTITION BY o ORDER BY s) AS r, s::DOUBLE AS b FROM base) USING (series_uuid, r) GROUP BY 1) GROUP BY 1")
def sorted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = X.base(spark, sf_dir).groupBy(F.col("o").cast("string").alias("series_uuid")).agg(F.collect_list("q").alias("a"), F.collect_list(F.col("s").cast("double")).alias("b"))
    return lists.select("series_uuid", F.round(C.sorted_assignment(F.col("a"), F.col("b"))["cost"], 6).alias("cost"))


@query(_FLAT_SQL.format(w=""))
def structured_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scoring.with_structured_errors(X.grouped_pairs(spark, sf_dir)), "structured_errors")


@query("SELECT series_uuid, pred_id, gt_id, dimension, severity, count(*) AS n FROM text_errors GROUP BY 1, 2, 3, 4, 5")
def suppress_duplicate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(X.score_pairs(spark, sf_dir), "text_errors")


@query("SELECT series_uuid, pred_id, gt_id, muc_category, inc_triggered FROM records")
def classify_muc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.score_pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", "muc_category", "inc_triggered")


@query("SELECT series_uuid, pred_id, gt_id, category FROM records")
def effective_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.score_pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", "category")


@query("""SELECT r.series_uuid, r.pred_id, r.gt_id, category, inc_triggered, gt_sig, pred_sig, array_to_string(gt_subsets, ',') AS gt_subsets, count(e.dimension) FILTER (source = 'structured') AS n_structured, count(e.dimension) FILTER (source = 'text') AS n_text
  FROM records r LEFT JOIN all_errors e ON r.series_uuid = e.series_uuid AND r.pred_id = e.pred_id AND r.gt_id = e.gt_id GROUP BY ALL""")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return X.score_pairs(spark, sf_dir).select("series_uuid", "pred_id", "gt_id", "category", "inc_triggered", "gt_sig", "pred_sig", F.array_join("gt_subsets", ",").alias("gt_subsets"), size("structured_errors").alias("n_structured"), size("text_errors").alias("n_text"))


# Aggregations

_GT_SQL = "gt_out AS (SELECT {k} series_uuid, gt_id, bool_or(category <> 'INC') AS hit, bool_and(category = 'INC') AS all_inc, any_value(gt_sig) AS sig, list_sort(list(DISTINCT pred_sig)) AS other_sigs FROM {r} GROUP BY ALL)"
_PRED_SQL = "pred_out AS (SELECT {k} series_uuid, pred_id, bool_or(category <> 'INC') AS hit, any_value(pred_sig) AS sig FROM {r} GROUP BY ALL)"
_CON_SQL = "contra AS (SELECT {k} r.series_uuid, r.pred_id, any_value(pred_sig) AS sig FROM {r} r JOIN gt_out USING ({u} series_uuid, gt_id) GROUP BY ALL HAVING bool_and(category = 'INC') AND NOT bool_or(all_inc))"


def _scope_sql(key: str | None = None) -> str:
    """Common tables of a scope: none, the series, or the subset."""
    k = {None: "", "series_uuid": "", "subset": "subset,"}[key]
    r, o = ("records", "orphans") if key != "subset" else ("(SELECT *, unnest(gt_subsets) AS subset FROM records)", "(SELECT *, unnest(subsets) AS subset FROM orphans)")
    flag = lambda w, n: f"count(*) FILTER ({w}) AS {n}"
    inside, claimed = "list_contains(pool, sig)", "list_has_any(pool, other_sigs)"
    group = {None: "", "series_uuid": "series_uuid,", "subset": "subset,"}[key]
    return f""", {_GT_SQL.format(k=k, r=r)}, {_PRED_SQL.format(k=k, r=r)}, {_CON_SQL.format(k=k, r=r, u=k)},
events AS (SELECT {k} series_uuid, 'gt' AS kind, sig, hit, all_inc, other_sigs FROM gt_out UNION ALL SELECT {k} series_uuid, 'pred', sig, hit, false, [] FROM pred_out UNION ALL SELECT {k} series_uuid, 'contradicted', sig, false, false, [] FROM contra
  UNION ALL SELECT {k} series_uuid, 'missed', clinical_significance, false, false, [] FROM {o} WHERE side = 'gt' AND (clinical_status <> 'normal' OR clinical_significance <> 'routine')
  UNION ALL SELECT {k} series_uuid, 'unsupported', clinical_significance, false, false, [] FROM {o} WHERE side = 'pred' AND clinical_status <> 'normal'),
counts AS (SELECT {group} tier, {flag(f"kind = 'missed' AND {inside}", 'fn_mis')}, {flag(f"kind = 'gt' AND all_inc AND {inside}", 'fn_inc')}, {flag(f"kind = 'unsupported' AND {inside}", 'fp_spu')},
  {flag(f"(kind = 'gt' AND all_inc AND NOT {inside} AND {claimed}) OR (kind = 'contradicted' AND {inside})", 'fp_inc')}, {flag(f"(kind = 'gt' AND ({inside} OR {claimed})) OR (kind IN ('missed', 'unsupported', 'contradicted') AND {inside})", 'findings_at_stake')},
  {flag(f"kind = 'gt' AND {inside} AND hit", 'recall_hits')}, {flag(f"kind IN ('gt', 'missed') AND {inside}", 'recall_total')}, {flag(f"kind = 'pred' AND {inside} AND hit", 'precision_hits')}, {flag(f"kind IN ('pred', 'unsupported') AND {inside}", 'precision_total')} FROM events, tier GROUP BY ALL),
rated AS (SELECT *, fn_mis + fn_inc AS fn, fp_spu + fp_inc AS fp, fn_mis + fn_inc + fp_spu + fp_inc AS errors, coalesce((fn_mis + fn_inc + fp_spu + fp_inc) / nullif(findings_at_stake, 0), 0.0) AS errors_per_finding,
  recall_hits / nullif(recall_total, 0) AS recall, precision_hits / nullif(precision_total, 0) AS "precision" FROM counts),
best AS (SELECT {group} max({X._RANK.format(c='category')}) AS r FROM {r} GROUP BY {k} series_uuid, gt_id),
muc AS (SELECT {group} sum(COR)::BIGINT AS COR, sum(PAR)::BIGINT AS PAR, sum(INC)::BIGINT AS INC, sum(MIS)::BIGINT AS MIS, sum(SPU)::BIGINT AS SPU FROM (SELECT {group} (r = 3)::INT AS COR, (r = 2)::INT AS PAR, (r = 1)::INT AS INC, 0 AS MIS, 0 AS SPU FROM best
  UNION ALL SELECT {group} 0, 0, 0, (side = 'gt')::INT, (side = 'pred')::INT FROM {o}) GROUP BY ALL)"""


_R6 = ("errors_per_finding", "recall", "precision")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c.endswith(("_per_finding", "_per_report", "_pct")) or c in _R6 else c for c in df.columns))


_R6_SQL = """* REPLACE (round(errors_per_finding, 6) AS errors_per_finding, round(recall, 6) AS recall, round("precision", 6) AS "precision")"""


@query(f"{_scope_sql()} SELECT series_uuid, gt_id, hit, all_inc, sig, array_to_string(other_sigs, ',') AS other_sigs FROM gt_out")
def gt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gt_outcomes(X.score_pairs(spark, sf_dir)).withColumn("other_sigs", F.array_join(F.sort_array("other_sigs"), ","))


@query(f"{_scope_sql()} SELECT series_uuid, pred_id, hit, sig FROM pred_out")
def pred_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pred_outcomes(X.score_pairs(spark, sf_dir))


@query(f"{_scope_sql()} SELECT series_uuid, pred_id, sig FROM contra")
def contradicted_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contradicted(X.score_pairs(spark, sf_dir))


@query(f"{_scope_sql()} SELECT * FROM muc")
def muc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.muc_counts(*X.scored(spark, sf_dir))


@query("""SELECT count(DISTINCT (series_uuid, pred_id)) AS evaluated_pred, count(DISTINCT (series_uuid, gt_id)) AS evaluated_gt, count(DISTINCT (series_uuid, pred_id)) + (SELECT count(*) FROM orphans WHERE side = 'pred') AS total_pred,
  count(DISTINCT (series_uuid, gt_id)) + (SELECT count(*) FROM orphans WHERE side = 'gt') AS total_gt FROM records""")
def distinct_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_findings(*X.scored(spark, sf_dir))


@query(f"{_scope_sql()} SELECT tier, fn_mis, fn_inc, fp_spu, fp_inc, fn, fp, errors FROM rated")
def tier_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tier_metrics(*X.scored(spark, sf_dir)).select("tier", "fn_mis", "fn_inc", "fp_spu", "fp_inc", "fn", "fp", "errors")


@query(f"{_scope_sql()} SELECT tier, findings_at_stake FROM rated")
def findings_at_stake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tier_metrics(*X.scored(spark, sf_dir)).select("tier", "findings_at_stake")


@query(f"{_scope_sql()} SELECT {_R6_SQL} FROM rated")
def tier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.tier_metrics(*X.scored(spark, sf_dir)))


_PER_REPORT_SQL = ", ".join(f"round({c} / (SELECT count(*) FROM series), 6) AS {c}_per_report" for c in ("errors", "fn", "fp"))


@query(f"{_scope_sql()} SELECT {_R6_SQL}, {_PER_REPORT_SQL} FROM rated")
def tiers_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.tier_metrics(*X.scored(spark, sf_dir))
    n = X.series(spark, sf_dir).agg(F.count("*").alias("n_reports"))
    return _rounded(metrics.per_report_rates(out.crossJoin(n), F.col("n_reports")).drop("n_reports"))


@query(f"""{_scope_sql('series_uuid')} SELECT series_uuid, tier, coalesce(errors, 0) AS errors, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(findings_at_stake, 0) AS findings_at_stake, coalesce(COR, 0) AS COR, coalesce(PAR, 0) AS PAR, coalesce(INC, 0) AS INC, coalesce(MIS, 0) AS MIS, coalesce(SPU, 0) AS SPU
  FROM series CROSS JOIN tier LEFT JOIN rated USING (series_uuid, tier) LEFT JOIN muc USING (series_uuid)""")
def per_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_report(spark, sf_dir)


def _per_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_report(*X.scored(spark, sf_dir), X.series(spark, sf_dir))


def _by_report(records: DataFrame, orphans: DataFrame, series: DataFrame) -> DataFrame:
    tiers = metrics.tier_metrics(records, orphans, ["series_uuid"], series).select("series_uuid", "tier", "errors", "fn", "fp", "findings_at_stake")
    return tiers.join(metrics.muc_counts(records, orphans, ["series_uuid"]), "series_uuid", "left").fillna(0, list(schema.OUTCOMES))


@query(f"""{_scope_sql('subset')} SELECT x.*, COR, PAR, INC, MIS, SPU FROM (SELECT {_R6_SQL} FROM rated) x JOIN muc USING (subset)""")
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, orphans = metrics.by_subset(*X.scored(spark, sf_dir))
    return _rounded(metrics.tier_metrics(records, orphans, ["subset"])).join(metrics.muc_counts(records, orphans, ["subset"]), "subset")


_DIMS = "(SELECT unnest([" + ", ".join(repr(d) for d in schema.DIMENSIONS) + "]) AS dimension)"
_BREAKDOWN_SQL = f"""worst AS (SELECT series_uuid, pred_id, gt_id, dimension, bool_or(severity = 'major') AS major FROM all_errors GROUP BY 1, 2, 3, 4),
breakdown AS (SELECT dimension, total - coalesce(n, 0) AS clean, coalesce(n - m, 0) AS minor, coalesce(m, 0) AS major, total AS evaluated FROM {_DIMS} d CROSS JOIN (SELECT count(*) AS total FROM records) t
  LEFT JOIN (SELECT dimension, count(*) AS n, count(*) FILTER (major) AS m FROM worst GROUP BY 1) w USING (dimension))"""


@query(f", {_BREAKDOWN_SQL} SELECT *, round(clean / evaluated, 6) AS clean_pct, round(minor / evaluated, 6) AS minor_pct, round(major / evaluated, 6) AS major_pct FROM breakdown")
def attribute_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.attribute_breakdown(X.score_pairs(spark, sf_dir)))
