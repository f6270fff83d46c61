"""Findings, links and replies derived from the driver's tables, in Spark and in DuckDB.

The tables hold no findings, so order lines become findings by integer arithmetic: one series is one order, one slot is one
line number.  ``k``, ``s`` and ``q`` are the line's part, supplier and quantity.  The expressions below run in both engines.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmark.operators import links, scoring
from findmark.sources.scratch import chosen, stored, stored_by_series

_SIG = "CASE ({x}) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'urgent' WHEN 2 THEN 'notable' ELSE 'routine' END"
_SIDE = "CASE ({x}) % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'bilateral' END"
_COMP = "CASE ({x}) % 8 WHEN 0 THEN 'stable' WHEN 1 THEN 'new' WHEN 2 THEN 'worsening' WHEN 3 THEN 'improving' END"
_TEXT = "CASE k % 9 WHEN 0 THEN 'Possible ' WHEN 1 THEN 'No definite ' WHEN 2 THEN 'Probably ' ELSE '' END || name"
_UNIT = "CASE k % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' END"
_CAT = "CASE k % 5 WHEN 0 THEN 'size' WHEN 1 THEN 'count' WHEN 2 THEN 'attenuation' WHEN 3 THEN 'ratio' ELSE 'other' END"
#: Columns of a finding, by side: name, expression.
SCALARS = {
    "gt": {
        "text": _TEXT,
        "clinical_status": "CASE WHEN k % 3 = 0 THEN 'normal' ELSE 'abnormal' END",
        "clinical_significance": _SIG.format(x="k"),
        "laterality": _SIDE.format(x="k"),
        "comparison": _COMP.format(x="k"),
    },
    "pred": {
        "text": f"CASE s % 3 WHEN 0 THEN upper({_TEXT}) WHEN 1 THEN {_TEXT} ELSE ({_TEXT}) || '  again ' END",
        "clinical_status": "CASE WHEN (k % 3 = 0) <> (s % 11 = 0) THEN 'normal' ELSE 'abnormal' END",
        "clinical_significance": _SIG.format(x="k + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END"),
        "laterality": _SIDE.format(x="k + CASE WHEN s % 7 = 0 THEN 1 ELSE 0 END"),
        "comparison": _COMP.format(x="k + CASE WHEN s % 6 = 0 THEN 1 ELSE 0 END"),
    },
}
KEEP = {"gt": "k % 10 <> 0", "pred": "k % 10 <> 1"}
_VALUE = {"gt": "q", "pred": "CASE s % 4 WHEN 0 THEN q WHEN 1 THEN q * 1.125 ELSE q * 1.5 END"}
_GIVEN = {"gt": ("k % 2 = 0", "k % 12 = 0"), "pred": ("k % 2 = 0 AND s % 4 <> 3", "k % 12 = 0 AND s % 4 <> 3 AND s % 8 <> 1")}


def _measurements(side: str, engine: str) -> str:
    value, (one, two) = _VALUE[side], _GIVEN[side]
    if engine == "spark":
        item = "array(named_struct('value', {v}, 'unit', {u}, 'category', {c}))"
        none = "CAST(array() AS array<struct<value:double,unit:string,category:string>>)"
        join = "concat({a}, {b})"
    else:
        item = "[{{'value': {v}, 'unit': {u}, 'category': {c}}}]"
        none = "CAST([] AS STRUCT(value DOUBLE, unit VARCHAR, category VARCHAR)[])"
        join = "({a} || {b})"
    first = item.format(v=f"CAST({value} AS DOUBLE)", u=_UNIT, c=_CAT)
    second = item.format(v=f"CAST({value} + 4 AS DOUBLE)", u=_UNIT, c="CASE WHEN k % 24 = 0 THEN " + _CAT + " ELSE 'size' END")
    return join.format(a=f"CASE WHEN {one} THEN {first} ELSE {none} END", b=f"CASE WHEN {two} THEN {second} ELSE {none} END")


#: Derived tables by name and folder, for a run of many queries that sets this to a dict; else each query derives its own.
shared: dict | None = None


def _once(f):
    """``f``, whose tables are kept in ``shared`` while that is a dict."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str):
        if shared is None:
            return f(spark, sf_dir)
        key = f.__name__, sf_dir
        if key not in shared:
            out = f(spark, sf_dir)
            keep = lambda df: df if hasattr(df, "_stored_at") else (stored_by_series if "series_uuid" in df.columns else stored)(df, f.__name__)
            shared[key] = tuple(map(keep, out)) if isinstance(out, tuple) else keep(out)
        return shared[key]

    return run


@_once
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number; the raw table repeats some."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("n")).agg(F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("double").alias("q"))
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return lines.join(names, "k", "left").withColumn("name", F.coalesce("name", F.lit("part")))


def by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base`` with its series, kept as a table by series: what is derived from it stays in place."""
    return stored_by_series(base(spark, sf_dir).withColumn("series_uuid", F.col("o").cast("string")), "base")


def _side(own: DataFrame, side: str, extra: tuple[str, ...] = ()) -> DataFrame:
    own = own if "series_uuid" in own.columns else own.withColumn("series_uuid", F.col("o").cast("string"))
    return own.where(KEEP[side]).selectExpr(
        "series_uuid", f"'{side}' AS side", "n AS pos", "CAST(o AS string) || '_' || lpad(CAST(n AS string), 3, '0') AS finding_id",
        *(f"{e} AS {c}" for c, e in SCALARS[side].items()), f"{_measurements(side, 'spark')} AS measurements", *extra,
    )


def findings(spark: SparkSession, sf_dir: str, side: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return _side(base(spark, sf_dir), side, extra)


def _both(own: DataFrame) -> DataFrame:
    return _side(own, "gt").unionByName(_side(own, "pred"))


def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(by_series(spark, sf_dir))


def _links(own: DataFrame) -> DataFrame:
    """Links between the same slots, and to the next slot where ``k % 13 = 0``: groups and chains."""
    name = "CAST(o AS string) || '_' || lpad(CAST({n} AS string), 3, '0')"
    p = own.where(KEEP["pred"]).selectExpr("series_uuid", "n AS pos", f"{name.format(n='n')} AS pred_id", "k", "s", "q")
    g = own.where(KEEP["gt"]).selectExpr("series_uuid", "n AS to", f"{name.format(n='n')} AS gt_id")
    p = p.withColumn("to", F.explode(F.when(F.col("k") % 13 == 0, F.array("pos", F.col("pos") + 1)).otherwise(F.array("pos"))))
    return p.join(g, ["series_uuid", "to"]).select("series_uuid", "pred_id", "gt_id", "pos", "to", "k", "s", "q")


@_once
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(by_series(spark, sf_dir))


@_once
def kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(findings, matches)`` of both sides: findings are read off the kept lines, matches are kept as a table."""
    own = by_series(spark, sf_dir)
    return _both(own), stored_by_series(_links(own), "matches")


#: Text errors of a link: when, dimension, severity.
TEXT_ERRORS = (("k % 17 = 0", "location", "minor"), ("k % 19 = 0", "grade", "major"), ("k % 23 = 0", "certainty", "minor"), ("k % 29 = 0", "measurement", "minor"), ("k % 31 = 0", "comparison", "major"))


def text_errors() -> F.Column:
    one = lambda d, s: f"named_struct('dimension', '{d}', 'severity', '{s}', 'reasoning', 'read')"
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {w} THEN {one(d, s)} END" for w, d, s in TEXT_ERRORS) + "))")


@_once
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = by_series(spark, sf_dir)
    return links.pair_findings(_links(own), _side(own, "pred"), _side(own, "gt"))


@_once
def grouped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the sides of their groups and whether a size is given elsewhere."""
    return scoring.linked_pairs(*kept(spark, sf_dir))


def _records(found: DataFrame, linked: DataFrame) -> DataFrame:
    rows = scoring.with_structured_errors(scoring.linked_pairs(found, chosen(linked, *scoring.KEYS, "k")))
    told = F.when(F.col("needs_judge"), text_errors()).otherwise(F.filter(text_errors(), lambda _: F.lit(False)))
    return stored_by_series(scoring.records(rows.withColumn("errors", told)), "records")


@_once
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per link with both error lists and its effective category; kept as a table, as metrics read it often."""
    return _records(*kept(spark, sf_dir))


@_once
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.orphans(*kept(spark, sf_dir))


@_once
def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(findings, records, orphans)`` of one derivation."""
    found, linked = kept(spark, sf_dir)
    return found, _records(found, linked), stored_by_series(scoring.orphans(found, linked), "orphans")


@_once
def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(records, orphans)``, both kept as tables."""
    return audited(spark, sf_dir)[1:]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders: series exist without findings too."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("series_uuid")).distinct()


def _side_sql(side: str) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in SCALARS[side].items())
    return f"{side} AS MATERIALIZED (SELECT o::VARCHAR AS series_uuid, '{side}' AS side, n AS pos, o::VARCHAR || '_' || lpad(n::VARCHAR, 3, '0') AS finding_id, {cols}, {_measurements(side, 'duckdb')} AS measurements, k, s, q FROM base WHERE {KEEP[side]})"


_RANK = "CASE {c} WHEN 'COR' THEN 3 WHEN 'PAR' THEN 2 ELSE 1 END"
_HEDGE = r"regexp_matches(lower({c}), '\b(possibl|probabl|may|might|cannot|can''t|not (be )?(excluded|ruled out)|questionabl|equivocal|indeterminate|suspicious|likely|unlikely|no (definite|definitive|convincing))')"
_FLAT = "regexp_replace(trim(lower({c})), '\\s+', ' ', 'g')"
_CANON = "({m}.value * CASE lower({m}.unit) WHEN 'cm' THEN 10.0 WHEN 'inch' THEN 25.4 WHEN 'in' THEN 25.4 WHEN 'inches' THEN 25.4 WHEN 'l' THEN 1000.0 ELSE 1.0 END)"
_KIND = "CASE WHEN {m}.unit IS NULL THEN NULL WHEN lower({m}.unit) IN ('mm', 'cm', 'inch', 'in', 'inches') THEN 'length' WHEN lower({m}.unit) IN ('ml', 'l') THEN 'volume' ELSE lower({m}.unit) END"
NEEDS_JUDGE = f"CASE WHEN p_clinical_status <> g_clinical_status THEN false WHEN p_clinical_status = 'normal' THEN {_HEDGE.format(c='p_text')} OR {_HEDGE.format(c='g_text')} ELSE {_FLAT.format(c='p_text')} <> {_FLAT.format(c='g_text')} END"


def _exceeds(p: str, g: str, share: float) -> str:
    return f"CASE WHEN {g} = 0 THEN {p} <> 0 ELSE abs({p} - {g}) / abs({g}) > {share} END"


def measurement_severity_sql(cat: str, p: str = "pm", g: str = "gm") -> str:
    """Severity of a measurement pair, null for none."""
    a, b = _CANON.format(m=p), _CANON.format(m=g)
    ka, kb = _KIND.format(m=p), _KIND.format(m=g)
    return f"""CASE {cat} WHEN 'size' THEN CASE WHEN ({ka}) <> ({kb}) OR (({_exceeds(a, b, 0.2)}) AND abs({a} - {b}) >= 2.0) THEN 'minor' END
      WHEN 'ratio' THEN CASE WHEN {_exceeds(a, b, 0.3)} THEN 'major' END WHEN 'count' THEN CASE WHEN {p}.value <> {g}.value THEN 'major' END
      WHEN 'attenuation' THEN CASE WHEN ({a} <= -10) <> ({b} <= -10) OR ({a} <= 10) <> ({b} <= 10) OR ({a} <= 20) <> ({b} <= 20) OR abs({a} - {b}) > 20 THEN 'major' END
      ELSE CASE WHEN {p}.value <> {g}.value THEN 'minor' END END"""


def _subset_sql(x: str) -> str:
    return f"list_filter([CASE WHEN len({x}measurements) > 0 THEN 'measurement' END, CASE WHEN {x}comparison IS NOT NULL THEN 'comparison' END, CASE WHEN len({x}measurements) = 0 AND {x}comparison IS NULL THEN CASE WHEN {x}clinical_status = 'normal' THEN 'normal-regular' ELSE 'abnormal-regular' END END], lambda x: x IS NOT NULL)"


_P_COLS = ("pos", *SCALARS["gt"], "measurements")
#: Common table expressions for the SQL of all queries; unused ones cost nothing.
SQL = f"""WITH RECURSIVE base AS MATERIALIZED (SELECT o, n, k, s, q, coalesce(p_name, 'part') AS name FROM
  (SELECT l_orderkey AS o, l_linenumber::INT AS n, min(l_partkey) AS k, min(l_suppkey) AS s, min(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1, 2) LEFT JOIN part ON p_partkey = k),
{_side_sql("gt")}, {_side_sql("pred")},
findings AS (SELECT * FROM gt UNION ALL SELECT * FROM pred),
matches AS MATERIALIZED (SELECT p.series_uuid, p.finding_id AS pred_id, g.finding_id AS gt_id, p.pos, g.pos AS "to", p.k, p.s, p.q FROM pred p JOIN gt g
  ON p.series_uuid = g.series_uuid AND (g.pos = p.pos OR (p.k % 13 = 0 AND g.pos = p.pos + 1))),
pairs AS MATERIALIZED (SELECT m.*, {", ".join(f"p.{c} AS p_{c}, g.{c} AS g_{c}" for c in _P_COLS)} FROM matches m
  JOIN pred p ON m.series_uuid = p.series_uuid AND m.pred_id = p.finding_id JOIN gt g ON m.series_uuid = g.series_uuid AND m.gt_id = g.finding_id),
elsewhere AS MATERIALIZED (SELECT a.series_uuid, a.pred_id, a.gt_id, coalesce(bool_or(b.pred_id IS NOT NULL), false) AS size_elsewhere FROM pairs a LEFT JOIN pairs b
  ON a.series_uuid = b.series_uuid AND a.gt_id = b.gt_id AND a.pred_id <> b.pred_id AND len(list_filter(b.p_measurements, lambda m: m.category = 'size')) > 0 GROUP BY 1, 2, 3),
undirected AS MATERIALIZED (SELECT series_uuid, 'p:' || pred_id AS a, 'g:' || gt_id AS b FROM matches UNION SELECT series_uuid, 'g:' || gt_id, 'p:' || pred_id FROM matches),
reach(series_uuid, v, u) AS (SELECT series_uuid, a, a FROM undirected UNION SELECT r.series_uuid, r.v, e.b FROM reach r JOIN undirected e ON r.series_uuid = e.series_uuid AND r.u = e.a),
component AS MATERIALIZED (SELECT series_uuid, v, min(u) AS component FROM reach GROUP BY 1, 2),
linked AS MATERIALIZED (SELECT m.*, c.component FROM matches m JOIN component c ON m.series_uuid = c.series_uuid AND c.v = 'p:' || m.pred_id),
groups AS MATERIALIZED (SELECT series_uuid, component, list_sort(list(DISTINCT pred_id)) AS group_preds, list_sort(list(DISTINCT gt_id)) AS group_gts FROM linked GROUP BY 1, 2),
members AS (SELECT series_uuid, component, 'pred' AS side, unnest(group_preds) AS finding_id FROM groups UNION ALL SELECT series_uuid, component, 'gt', unnest(group_gts) FROM groups),
sides AS MATERIALIZED (SELECT m.series_uuid, m.component, m.side, CASE WHEN bool_or(f.laterality = 'bilateral') OR (bool_or(f.laterality = 'left') AND bool_or(f.laterality = 'right')) THEN 'bilateral'
    WHEN bool_or(f.laterality = 'left') THEN 'left' WHEN bool_or(f.laterality = 'right') THEN 'right' END AS side_union
  FROM members m JOIN findings f ON m.series_uuid = f.series_uuid AND m.side = f.side AND m.finding_id = f.finding_id WHERE f.clinical_status = 'abnormal' GROUP BY 1, 2, 3),
grouped AS MATERIALIZED (SELECT p.*, e.size_elsewhere, l.component, sp.side_union AS p_group, sg.side_union AS g_group FROM pairs p
  JOIN elsewhere e ON p.series_uuid = e.series_uuid AND p.pred_id = e.pred_id AND p.gt_id = e.gt_id
  JOIN linked l ON p.series_uuid = l.series_uuid AND p.pred_id = l.pred_id AND p.gt_id = l.gt_id
  LEFT JOIN sides sp ON sp.series_uuid = l.series_uuid AND sp.component = l.component AND sp.side = 'pred'
  LEFT JOIN sides sg ON sg.series_uuid = l.series_uuid AND sg.component = l.component AND sg.side = 'gt'),
aligned AS (SELECT *, list_transform(p_measurements, lambda m: {{'value': m.value, 'unit': m.unit, 'category': coalesce(list_filter(g_measurements, lambda x: x.value IS NOT DISTINCT FROM m.value AND x.unit IS NOT DISTINCT FROM m.unit)[1].category, m.category)}}) AS pa FROM grouped),
cats AS MATERIALIZED (SELECT series_uuid, pred_id, gt_id, size_elsewhere, cat, list_filter(pa, lambda m: m.category = cat) AS ps, list_filter(g_measurements, lambda m: m.category = cat) AS gs
  FROM (SELECT *, unnest(['size', 'count', 'attenuation', 'ratio', 'other']) AS cat FROM aligned) WHERE len(list_filter(g_measurements, lambda m: m.category = cat)) > 0),
lack AS (SELECT series_uuid, pred_id, gt_id, cat, 'minor' AS severity FROM (SELECT *, unnest(gs) AS gm FROM cats WHERE len(ps) = 0 AND NOT (size_elsewhere AND cat = 'size'))),
assigned AS MATERIALIZED (SELECT series_uuid, pred_id, gt_id, cat, ps, gs, CASE
    WHEN len(ps) = 1 AND len(gs) = 1 THEN [[1, 1]]
    WHEN len(ps) = 1 THEN [[1, CASE WHEN abs({_CANON.format(m="ps[1]")} - {_CANON.format(m="gs[2]")}) < abs({_CANON.format(m="ps[1]")} - {_CANON.format(m="gs[1]")}) THEN 2 ELSE 1 END]]
    WHEN len(gs) = 1 THEN [[CASE WHEN abs({_CANON.format(m="gs[1]")} - {_CANON.format(m="ps[2]")}) < abs({_CANON.format(m="gs[1]")} - {_CANON.format(m="ps[1]")}) THEN 2 ELSE 1 END, 1]]
    WHEN abs({_CANON.format(m="ps[1]")} - {_CANON.format(m="gs[2]")}) + abs({_CANON.format(m="ps[2]")} - {_CANON.format(m="gs[1]")}) < abs({_CANON.format(m="ps[1]")} - {_CANON.format(m="gs[1]")}) + abs({_CANON.format(m="ps[2]")} - {_CANON.format(m="gs[2]")}) THEN [[1, 2], [2, 1]]
    ELSE [[1, 1], [2, 2]] END AS ij FROM cats WHERE len(ps) > 0),
compared AS (SELECT series_uuid, pred_id, gt_id, cat, ps[ij[1]] AS pm, gs[ij[2]] AS gm FROM (SELECT * REPLACE (unnest(ij) AS ij) FROM assigned)),
extra AS (SELECT series_uuid, pred_id, gt_id, cat, 'minor' AS severity FROM assigned WHERE len(gs) > len(ps)),
measured AS MATERIALIZED (SELECT * FROM lack UNION ALL SELECT series_uuid, pred_id, gt_id, cat, severity FROM (SELECT *, {measurement_severity_sql("cat")} AS severity FROM compared) WHERE severity IS NOT NULL UNION ALL SELECT * FROM extra),
structured AS MATERIALIZED (SELECT series_uuid, pred_id, gt_id, 'clinical_status' AS dimension, 'major' AS severity, true AS inc FROM grouped WHERE p_clinical_status <> g_clinical_status
  UNION ALL SELECT series_uuid, pred_id, gt_id, 'laterality', CASE WHEN p_clinical_significance = 'routine' AND g_clinical_significance = 'routine' THEN 'minor' ELSE 'major' END, false FROM grouped
    WHERE p_clinical_status = 'abnormal' AND g_clinical_status = 'abnormal' AND NOT (p_laterality IS NOT DISTINCT FROM g_laterality OR g_laterality IS NULL OR p_group IS NOT DISTINCT FROM g_group OR (p_group IS NULL AND g_group IS NOT DISTINCT FROM 'bilateral'))
  UNION ALL SELECT series_uuid, pred_id, gt_id, 'comparison', CASE WHEN p_comparison IS NULL OR g_comparison IS NULL THEN 'minor' WHEN (p_comparison IN ('new', 'worsening')) <> (g_comparison IN ('new', 'worsening')) THEN 'major' ELSE 'minor' END, false
    FROM grouped WHERE p_clinical_status = 'abnormal' AND g_clinical_status = 'abnormal' AND p_comparison IS DISTINCT FROM g_comparison
  UNION ALL SELECT m.series_uuid, m.pred_id, m.gt_id, 'measurement', severity, false FROM measured m JOIN grouped g ON m.series_uuid = g.series_uuid AND m.pred_id = g.pred_id AND m.gt_id = g.gt_id
    WHERE p_clinical_status = 'abnormal' AND g_clinical_status = 'abnormal'),
told AS (SELECT series_uuid, pred_id, gt_id, dimension, severity FROM (SELECT *, {NEEDS_JUDGE} AS judged FROM pairs) p, (VALUES {", ".join(f"('{d}', '{s}', {w.split()[2]})" for w, d, s in TEXT_ERRORS)}) t(dimension, severity, m) WHERE judged AND p.k % m = 0),
text_errors AS MATERIALIZED (SELECT t.* FROM told t LEFT JOIN (SELECT series_uuid, pred_id, gt_id, dimension, bool_or(severity = 'major') AS major FROM structured GROUP BY 1, 2, 3, 4) s
  ON t.series_uuid = s.series_uuid AND t.pred_id = s.pred_id AND t.gt_id = s.gt_id AND t.dimension = s.dimension
  WHERE t.dimension NOT IN ('measurement', 'comparison') OR s.major IS NULL OR (t.severity = 'major' AND NOT s.major)),
all_errors AS MATERIALIZED (SELECT series_uuid, pred_id, gt_id, dimension, severity, inc, 'structured' AS source FROM structured UNION ALL SELECT *, false, 'text' FROM text_errors),
verdicts AS (SELECT series_uuid, pred_id, gt_id, bool_or(inc) AS inc, bool_or(severity = 'major') AS major, bool_or(dimension = 'certainty') AS certainty, count(*) AS n FROM all_errors GROUP BY 1, 2, 3),
records AS MATERIALIZED (SELECT p.series_uuid, p.pred_id, p.gt_id, CASE WHEN v.inc THEN 'INC' WHEN v.n > 0 THEN 'PAR' ELSE 'COR' END AS muc_category, coalesce(v.inc, false) AS inc_triggered,
    CASE WHEN v.inc OR v.major OR (v.certainty AND p.g_clinical_significance = 'critical') THEN 'INC' WHEN v.n > 0 THEN 'PAR' ELSE 'COR' END AS category,
    p.g_clinical_significance AS gt_sig, p.p_clinical_significance AS pred_sig, {_subset_sql("g_")} AS gt_subsets
  FROM pairs p LEFT JOIN verdicts v ON p.series_uuid = v.series_uuid AND p.pred_id = v.pred_id AND p.gt_id = v.gt_id),
orphans AS MATERIALIZED (SELECT f.*, {_subset_sql("f.")} AS subsets FROM findings f LEFT JOIN (SELECT DISTINCT series_uuid, 'gt' AS side, gt_id AS finding_id FROM matches UNION ALL SELECT DISTINCT series_uuid, 'pred', pred_id FROM matches) m
  ON f.series_uuid = m.series_uuid AND f.side = m.side AND f.finding_id = m.finding_id WHERE m.finding_id IS NULL),
series AS (SELECT DISTINCT o_orderkey::VARCHAR AS series_uuid FROM orders),
tier(tier, pool) AS (VALUES ('all', ['critical', 'urgent', 'notable', 'routine']), ('significant', ['critical', 'urgent', 'notable']), ('triage', ['critical', 'urgent']), ('critical', ['critical']))"""
