"""Queries of the judge operators and the rule judges, with their SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findmark.functions import normalize as N
from findmark.functions import rules as R
from findmark.operators import judge as J
from findmark.operators import links, matcher, replies, runs, scoring
from findmark.plans import core
from findmark.plans import fixtures as X
from findmark.plans.core import query
from findmark.sources.scratch import new_path, stored, stored_by_series

_SYSTEM = "Read the report."


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("series_uuid"), F.lit("gt").alias("side"), "text")


def _indications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("series_uuid"), F.concat(F.lit("language "), "lang").alias("indication"))


@query("SELECT doc_id::VARCHAR AS series_uuid, 4 AS n_messages, sha256(CASE WHEN doc_id % 3 = 0 THEN 'Study indication: language ' || lang || chr(10) || chr(10) ELSE '' END || text) AS user_sha FROM documents")
def build_extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.extraction_requests(_reports(spark, sf_dir), _indications(spark, sf_dir), _SYSTEM, [("user", "an example"), ("assistant", "[]")])
    return out.select("series_uuid", F.size("messages").alias("n_messages"), F.sha2(F.element_at("messages", -1)["content"], 256).alias("user_sha"))


@query("SELECT doc_id::VARCHAR AS series_uuid, 2 AS n_messages, sha256(text) AS user_sha FROM documents")
def build_indication_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.indication_requests(_reports(spark, sf_dir), _SYSTEM)
    return out.select("series_uuid", F.size("messages").alias("n_messages"), F.sha2(F.element_at("messages", -1)["content"], 256).alias("user_sha"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("series_uuid"), F.col("o_orderpriority").alias("indication"))


@query("""SELECT series_uuid, n_pred, n_gt, CASE WHEN o.o_orderkey IS NOT NULL THEN o_orderpriority END AS indication, first_text FROM (SELECT series_uuid, count(*) FILTER (side = 'pred')::INT AS n_pred, count(*) FILTER (side = 'gt')::INT AS n_gt, min_by(text, pos) FILTER (side = 'pred') AS first_text FROM findings GROUP BY 1)
  LEFT JOIN (SELECT o_orderkey, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) o ON o.o_orderkey::VARCHAR = series_uuid WHERE n_pred > 0 AND n_gt > 0""")
def build_matching_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.matching_requests(J.finding_lists(X.both_sides(spark, sf_dir)), _orders(spark, sf_dir), _SYSTEM)
    one = "array<struct<finding_id:string,text:string,clinical_status:string,laterality:string>>"
    back = F.from_json(F.element_at("messages", -1)["content"], f"struct<indication:string,pred_findings:{one},gt_findings:{one}>")
    return out.withColumn("x", back).select("series_uuid", F.size("x.pred_findings").alias("n_pred"), F.size("x.gt_findings").alias("n_gt"), "x.indication", F.element_at("x.pred_findings", 1)["text"].alias("first_text"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.pairs(spark, sf_dir).withColumn("needs_judge", N.needs_judge("p_clinical_status", "g_clinical_status", "p_text", "g_text"))
    return pairs.withColumn("match_idx", F.row_number().over(Window.partitionBy("series_uuid").orderBy("pos", "to")) - 1)


_CHUNKS = f"""chunks AS (SELECT *, ((n - 1) // 10)::INT AS chunk, ((n - 1) % 10 + 1)::INT AS pair_id FROM (SELECT *, row_number() OVER (PARTITION BY series_uuid ORDER BY pos, "to") AS n FROM (SELECT *, {X.NEEDS_JUDGE} AS judged FROM pairs) WHERE judged))"""


def _told_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the pairs to be judged, with the other texts of their groups."""
    found, linked = X.kept(spark, sf_dir)
    rows = scoring.with_structured_errors(scoring.linked_pairs(found, linked))
    rows = rows.withColumn("match_idx", F.row_number().over(Window.partitionBy("series_uuid").orderBy("pos", "to")) - 1)
    return J.attribute_chunks(links.group_context(rows, *scoring.sides(found)))


_CONTEXT = """ctx AS (SELECT l.series_uuid, l.pred_id, l.gt_id, string_agg(f.text, '+' ORDER BY f.finding_id) FILTER (f.side = 'pred' AND f.finding_id <> l.pred_id) AS cp, string_agg(f.text, '+' ORDER BY f.finding_id) FILTER (f.side = 'gt' AND f.finding_id <> l.gt_id) AS cg
  FROM linked l JOIN members m ON l.series_uuid = m.series_uuid AND l.component = m.component JOIN findings f ON f.series_uuid = m.series_uuid AND f.side = m.side AND f.finding_id = m.finding_id GROUP BY 1, 2, 3)"""


@query(f""", {_CHUNKS}, {_CONTEXT} SELECT c.series_uuid, chunk, count(*)::INT AS n_pairs, string_agg(p_text, '|' ORDER BY pair_id) AS texts, string_agg(coalesce(cp, '') || '/' || coalesce(cg, ''), '|' ORDER BY pair_id) AS contexts, any_value(o_orderpriority) AS indication
  FROM chunks c JOIN ctx x ON c.series_uuid = x.series_uuid AND c.pred_id = x.pred_id AND c.gt_id = x.gt_id LEFT JOIN (SELECT o_orderkey::VARCHAR AS ok, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) o ON o.ok = c.series_uuid GROUP BY 1, 2""")
def build_attribute_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.attribute_requests(_told_chunks(spark, sf_dir), _SYSTEM, _orders(spark, sf_dir))
    back = F.from_json(F.element_at("messages", -1)["content"], "struct<indication:string,pairs:array<struct<pair_id:int,pred:string,gt:string,same_group_pred:array<string>,same_group_gt:array<string>>>>")
    told = lambda p, s: F.array_join(F.coalesce(p[f"same_group_{s}"], F.array().cast("array<string>")), "+")
    out = out.withColumn("x", back)
    return out.select("series_uuid", "chunk", "n_pairs", F.array_join(F.transform("x.pairs", lambda p: p["pred"]), "|").alias("texts"), F.array_join(F.transform("x.pairs", lambda p: F.concat(told(p, "pred"), F.lit("/"), told(p, "gt"))), "|").alias("contexts"), "x.indication")


def _length_judge(messages: list[dict]) -> str:
    """A stand-in for a model: tells the length, and fails on every seventh."""
    n = len(messages[-1]["content"])
    if n % 7 == 0:
        raise ValueError("not today")
    return json.dumps({"indication": str(n)})


@query("""SELECT doc_id::VARCHAR AS series_uuid, CASE WHEN length(text) % 7 <> 0 THEN '{"indication": "' || length(text) || '"}' END AS reply, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: not today' END AS error, CASE WHEN length(text) % 7 = 0 THEN 5 ELSE 1 END AS attempts FROM documents""")
def call_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.call_judge(J.indication_requests(_reports(spark, sf_dir), _SYSTEM), _length_judge, ["series_uuid"]).drop("usage")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = """'{"text": "' || text || '", "clinical_status": "' || clinical_status || '", "clinical_significance": "low", "measurements": [{"value": 1, "unit": "cc", "category": "size"}]}'"""
    rows = X.findings(spark, sf_dir, "gt").groupBy("series_uuid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.expr(item).alias("j")))), lambda x: x["j"]).alias("items"))
    body = F.concat(F.lit('{"findings": ['), F.array_join("items", ", "), F.lit("]}"))
    n = F.col("series_uuid").cast("long") % 31
    return rows.select("series_uuid", F.lit("gt").alias("side"), F.when(n == 0, F.lit('{"findings": [')).when(n == 1, F.lit('{"other": []}')).otherwise(body).alias("reply"))


@query("""SELECT series_uuid, series_uuid || '_' || lpad(rn::VARCHAR, 3, '0') AS finding_id, text, clinical_status, 'routine' AS clinical_significance, 'ml' AS unit, NULL AS reason FROM (SELECT *, row_number() OVER (PARTITION BY series_uuid ORDER BY pos) AS rn FROM gt WHERE series_uuid::BIGINT % 31 > 1)
  UNION ALL SELECT DISTINCT series_uuid, NULL, NULL, NULL, NULL, NULL, CASE WHEN series_uuid::BIGINT % 31 = 0 THEN 'not JSON' ELSE 'no list of findings' END FROM gt WHERE series_uuid::BIGINT % 31 < 2""")
def parse_findings_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, failed = J.parse_findings(_replies(spark, sf_dir))
    found = found.select("series_uuid", "finding_id", "text", "clinical_status", "clinical_significance", F.element_at("measurements", 1)["unit"].alias("unit"), F.lit(None).cast("string").alias("reason"))
    null = F.lit(None).cast("string")
    return found.union(failed.select("series_uuid", null, null, null, null, null, "reason"))


_IND = """CASE o_orderkey % 5 WHEN 0 THEN '{"indication":' WHEN 1 THEN '[]' WHEN 2 THEN '{"indication": 5}' ELSE '{"indication": " ' || o_orderpriority || ' "}' END"""


@query("SELECT o_orderkey::VARCHAR AS series_uuid, CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE o_orderpriority END AS indication FROM orders WHERE o_orderkey % 5 <> 0")
def parse_indication_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.parse_indications(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS string) AS series_uuid", f"{_IND} AS reply"))


def _answer_parts(found: DataFrame, linked: DataFrame) -> DataFrame:
    """Right answers of a matcher by series, as JSON parts, with the ids of both sides."""
    own = linked.groupBy("series_uuid").agg(F.array_sort(F.collect_list(F.struct("pos", "to", "pred_id", "gt_id"))).alias("own"))
    text = lambda x: F.concat(F.lit('{"pred_id": "'), x["pred_id"], F.lit('", "gt_id": "'), x["gt_id"], F.lit('"}'))
    m = own.select("series_uuid", F.transform("own", text).alias("m"), F.element_at("own", 1)["pred_id"].alias("one"), *(F.col(f"own.{s}_id").alias(f"in_{s}") for s in ("pred", "gt")))
    quoted = lambda c: F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    ids = reduce(lambda a, b: a.join(b, "series_uuid", "full"), (found.where(F.col("side") == s).groupBy("series_uuid").agg(F.sort_array(F.collect_set("finding_id")).alias(f"{s}_ids")) for s in ("pred", "gt")))
    none = F.array().cast("array<string>")
    out = ids.join(m, "series_uuid", "left").withColumns({c: F.coalesce(c, none) for c in ("pred_ids", "gt_ids", "m", "in_pred", "in_gt")})
    # what has no link, in order of the ids
    return out.withColumns({s: quoted(F.array_except(f"{s}_ids", f"in_{s}")) for s in ("pred", "gt")}).drop("in_pred", "in_gt")


def _answer(matched, pred, gt):
    return F.concat(F.lit('{"matches": ['), F.array_join(matched, ", "), F.lit('], "unmatched_pred": ['), F.array_join(pred, ", "), F.lit('], "unmatched_gt": '), gt, F.lit("}"))


@query("""SELECT f.series_uuid, (CASE f.series_uuid::BIGINT % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 + ug WHEN 2 THEN (nm > 0)::INT WHEN 3 THEN 1 WHEN 4 THEN (nm > 0)::INT WHEN 5 THEN up ELSE 0 END)::INT AS n_errors
  FROM (SELECT DISTINCT series_uuid FROM findings) f LEFT JOIN (SELECT series_uuid, count(*) AS nm FROM matches GROUP BY 1) m USING (series_uuid), LATERAL (SELECT count(*) FILTER (side = 'pred') AS up, count(*) FILTER (side = 'gt') AS ug FROM orphans o WHERE o.series_uuid = f.series_uuid)""".replace("(nm > 0)", "(coalesce(nm, 0) > 0)"))
def validate_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("series_uuid").cast("long") % 7
    full = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    with_one = F.when(F.col("one").isNotNull(), F.concat("pred", F.array(F.concat(F.lit('"'), "one", F.lit('"'))))).otherwise(F.col("pred"))
    right = _answer("m", "pred", full("gt"))
    reply = (
        F.when(r == 0, F.lit('{"matches": ['))
        .when(r == 1, _answer("m", "pred", F.lit('"none"')))
        .when(r == 2, _answer(F.concat("m", F.slice("m", 1, 1)), "pred", full("gt")))
        .when(r == 3, _answer("m", F.concat("pred", F.array(F.lit('"ghost"'))), full("gt")))
        .when(r == 4, _answer("m", with_one, full("gt")))
        .when(r == 5, _answer("m", F.array().cast("array<string>"), full("gt")))
        .otherwise(right)
    )
    checked = J.validate_matching(_answer_parts(*X.kept(spark, sf_dir)).select("series_uuid", reply.alias("reply"), "pred_ids", "gt_ids"))
    return checked.select("series_uuid", F.size("errors").alias("n_errors"))


@query("SELECT series_uuid, count(*) FILTER (side = 'pred')::INT AS n_pred, count(*) FILTER (side = 'gt')::INT AS n_gt FROM findings GROUP BY 1 HAVING count(*) FILTER (side = 'pred') = 0 OR count(*) FILTER (side = 'gt') = 0")
def trivial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.trivial_matches(J.finding_lists(X.both_sides(spark, sf_dir))).select("series_uuid", F.size("unmatched_pred").alias("n_pred"), F.size("unmatched_gt").alias("n_gt"))


@query("""SELECT series_uuid, (CASE WHEN s % 12 = 0 THEN 2 WHEN s % 6 = 0 THEN 2 WHEN s % 3 = 0 THEN 1 ELSE 0 END)::INT AS retries, s % 12 = 0 AS validation_fallback, n AS n_pairs FROM
  (SELECT f.series_uuid, f.series_uuid::BIGINT AS s, coalesce(m.n, 0)::INT AS n FROM (SELECT series_uuid FROM findings GROUP BY 1 HAVING count(DISTINCT side) = 2) f LEFT JOIN (SELECT series_uuid, count(*) AS n FROM matches GROUP BY 1) m USING (series_uuid))""")
def match_retry_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, linked = X.kept(spark, sf_dir)
    answers = stored_by_series(_answer_parts(found, linked), "answers")
    full = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    right, wrong = _answer("m", "pred", full("gt")), _answer("m", F.concat("pred", F.array(F.lit('"ghost"'))), full("gt"))

    def ask(requests: DataFrame, attempt: int) -> DataFrame:
        bad = F.col("series_uuid").cast("long") % (3 * 2**attempt) == 0
        return requests.join(answers, "series_uuid").select("series_uuid", F.when(bad, wrong).otherwise(right).alias("reply"))

    out = J.match_with_retries(J.finding_lists(found), _orders(spark, sf_dir), _SYSTEM, ask)
    return out.select("series_uuid", "retries", "validation_fallback", F.size("pairs").alias("n_pairs"))


@query("SELECT f.series_uuid, coalesce(n, 0)::INT AS n_pairs, np - coalesce(p, 0) AS n_pred FROM (SELECT series_uuid, count(*) FILTER (side = 'pred') AS np FROM findings GROUP BY 1) f LEFT JOIN (SELECT series_uuid, count(*) AS n, count(DISTINCT pred_id) AS p FROM matches GROUP BY 1) m USING (series_uuid)")
def match_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _answer(F.concat("m", "m", F.array(F.lit('{"pred_id": "ghost", "gt_id": "ghost"}'))), "pred", F.lit("[]"))
    checked = J.validate_matching(_answer_parts(*X.kept(spark, sf_dir)).select("series_uuid", twice.alias("reply"), "pred_ids", "gt_ids"))
    return J.fallback(checked).select("series_uuid", F.size("pairs").alias("n_pairs"), F.size("unmatched_pred").cast("long").alias("n_pred"))


@query("""SELECT series_uuid, pred_id, gt_id, (row_number() OVER (PARTITION BY series_uuid ORDER BY pos, gt_id DESC) - 1)::INT AS match_idx FROM matches""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = Window.partitionBy("series_uuid").orderBy(F.desc("gt_id"), F.desc("pred_id"))
    m = X.matches(spark, sf_dir).select("series_uuid", "pred_id", "gt_id").withColumn("reply_pos", F.row_number().over(back))
    return J.in_input_order(m, X.findings(spark, sf_dir, "pred")).select("series_uuid", "pred_id", "gt_id", "match_idx")


@query("SELECT series_uuid, side, finding_id, CASE side WHEN 'pred' THEN 'p_' ELSE 'gt_' END || row_number() OVER (PARTITION BY series_uuid, side ORDER BY pos) AS alias FROM findings")
def alias_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.alias_ids(X.both_sides(spark, sf_dir)).select("series_uuid", "side", "finding_id", "alias")


@query(f", {_CHUNKS} SELECT series_uuid, chunk, series_uuid::BIGINT % 5 > 2 AS ok, (CASE WHEN series_uuid::BIGINT % 5 > 2 THEN count(*) ELSE 0 END)::INT AS n_errors FROM chunks GROUP BY 1, 2")
def parse_attribute_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = J.attribute_chunks(_judged(spark, sf_dir)).groupBy("series_uuid", "chunk").agg(F.count("*").cast("int").alias("n_pairs"))
    r = F.col("series_uuid").cast("long") % 5
    ids = F.sequence(F.lit(1), F.col("n_pairs"))
    item = lambda i: F.concat(F.lit('{"pair_id": '), i, F.lit(', "errors": [{"dimension": "grade", "severity": "minor"}, {"dimension": "hue", "severity": "minor"}]}'))
    listed = F.when(r == 0, F.transform(ids, lambda i: item(F.lit("true")))).when(r == 1, F.transform(ids, lambda i: item(F.concat(i.cast("string"), F.lit(".0"))))).when(r == 2, F.transform(F.filter(ids, lambda i: i < F.col("n_pairs")), lambda i: item(i.cast("string")))).otherwise(F.transform(F.reverse(ids), lambda i: item(i.cast("string"))))
    replies = sizes.withColumn("reply", F.concat(F.lit('{"errors_per_pair": ['), F.array_join(listed, ", "), F.lit("]}")))
    return J.parse_attribute_replies(replies).select("series_uuid", "chunk", "ok", F.coalesce(F.aggregate("answers", F.lit(0), lambda n, a: n + F.size(a["errors"])), F.lit(0)).alias("n_errors"))


@query(f", {_CHUNKS} SELECT series_uuid, pred_id, gt_id FROM chunks")
def attribute_retry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ask(requests: DataFrame, attempt: int) -> DataFrame:
        item = F.transform("asked", lambda p: F.concat(F.lit('{"pair_id": '), p["pair_id"].cast("string"), F.lit(', "errors": []}')))
        return requests.withColumn("reply", F.when(F.col("n_pairs") <= 3, F.concat(F.lit('{"errors_per_pair": ['), F.array_join(item, ", "), F.lit("]}"))).otherwise("{}"))

    null = F.lit(None).cast("array<string>")
    answers, _ = J.judge_with_splits(J.attribute_chunks(_judged(spark, sf_dir)).withColumn("same_group_pred", null).withColumn("same_group_gt", null), ask, retries=0)
    return answers.select("series_uuid", "pred_id", "gt_id")


@query(f"{core._scope_sql()} SELECT {core._R6_SQL} FROM rated")
def audit_with_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From findings to the tier table: matching with retries, judging with retries and splits, scoring and the summary.

    The recorded matcher's first answers have no matches; the recorded judge's first answers are no JSON, and it never
    answers more than three pairs at once.
    """
    found, linked = X.kept(spark, sf_dir)
    right = stored_by_series(_answer_parts(found, linked), "answers")
    full = F.concat(F.lit("["), F.array_join("gt", ", "), F.lit("]"))

    def match(requests: DataFrame, attempt: int) -> DataFrame:
        if attempt == 0:
            return requests.select("series_uuid", F.lit('{"matches": []}').alias("reply"))
        return requests.select("series_uuid").join(right, "series_uuid").select("series_uuid", _answer("m", "pred", full).alias("reply"))

    out = J.match_with_retries(J.finding_lists(found, both=True), _orders(spark, sf_dir), _SYSTEM, match)
    matched = stored_by_series(out.select("series_uuid", F.inline("pairs")), "matched")

    def judge(requests: DataFrame, attempt: int) -> DataFrame:
        keys = ["series_uuid", "chunk", "part"]
        if attempt == 0:
            return requests.select(*keys, F.lit("no JSON").alias("reply"))
        pairs = requests.where("n_pairs <= 3").select(*keys, F.explode("asked").alias("a")).select(*keys, "a.*")
        item = F.struct("pair_id", X.text_errors().alias("errors"))
        return pairs.join(linked, ["series_uuid", "pred_id", "gt_id"]).groupBy(*keys).agg(F.to_json(F.struct(F.collect_list(item).alias("errors_per_pair"))).alias("reply"))

    whole = scoring.audit(found, matched, ask=judge, indications=_orders(spark, sf_dir), system=_SYSTEM, retries=1)
    return core._rounded(whole.tiers)


_SEEN = "struct<pred_findings:array<struct<finding_id:string>>,gt_findings:array<struct<finding_id:string>>>"


def _stand_ins(log: replies.ReplyLog) -> runs.Judges:
    """Models by rules: reports are their own findings, equal places match, no pair has a text error."""

    def extract(requests: DataFrame, attempt: int) -> DataFrame:
        return requests.select("series_uuid", "side", F.concat(F.lit('{"findings": '), F.element_at("messages", -1)["content"], F.lit("}")).alias("reply"))

    def match(requests: DataFrame, attempt: int) -> DataFrame:
        seen = F.from_json(F.element_at("messages", -1)["content"], _SEEN)
        ids = lambda side: F.transform(seen[f"{side}_findings"], lambda f: f["finding_id"])
        both = F.array_intersect(ids("pred"), ids("gt"))
        reply = F.struct(F.transform(both, lambda i: F.struct(i.alias("pred_id"), i.alias("gt_id"))).alias("matches"), F.array_except(ids("pred"), both).alias("unmatched_pred"), F.array_except(ids("gt"), both).alias("unmatched_gt"))
        return requests.select("series_uuid", F.to_json(reply).alias("reply"))

    def attributes(requests: DataFrame, attempt: int) -> DataFrame:
        none = F.array().cast("array<string>")
        reply = F.struct(F.transform("asked", lambda a: F.struct(a["pair_id"].alias("pair_id"), none.alias("errors"))).alias("errors_per_pair"))
        return requests.select("series_uuid", "chunk", "part", F.to_json(reply).alias("reply"))

    return runs.Judges(log.asking("extraction", ["series_uuid", "side"], extract), log.asking("matching", ["series_uuid"], match), log.asking("scoring", ["series_uuid", "chunk", "part"], attributes))


_PLACED = """placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_uuid, side ORDER BY pos) AS place FROM findings),
met AS MATERIALIZED (SELECT p.series_uuid, p.text AS p_text, p.clinical_status AS p_clinical_status, CASE WHEN {changed} AND g.place = 1 THEN g.text || ' changed' ELSE g.text END AS g_text, g.clinical_status AS g_clinical_status
  FROM placed p JOIN placed g ON p.series_uuid = g.series_uuid AND p.place = g.place WHERE p.side = 'pred' AND g.side = 'gt'),
sized AS MATERIALIZED (SELECT series_uuid, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gt') AS ng FROM findings GROUP BY 1)"""
_FEW = "p.series_uuid::BIGINT % 50 = 0"
_ASKED = """SELECT '{run}' AS run, {extraction} AS extraction_calls, {matching} AS matching_calls, {scoring} AS scoring_calls, (SELECT count(*) FROM sized) AS n_reports, (SELECT sum(least(np, ng))::BIGINT FROM sized) AS n_records, (SELECT sum(abs(np - ng))::BIGINT FROM sized) AS n_orphans"""
_CALLS = {
    "extraction": "(SELECT {n}count(*) FROM sized WHERE true{w})", "matching": "(SELECT count(*) FROM sized WHERE np > 0 AND ng > 0{w})",
    "scoring": "(SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT ceil(count(*) / 10)::BIGINT AS c FROM met WHERE ({j}){w} GROUP BY series_uuid))",
}


@query(f""", {_PLACED.format(changed=_FEW)} {_ASKED.format(run="first", extraction=_CALLS["extraction"].format(n="2 * ", w=""), matching=_CALLS["matching"].format(w=""), scoring=_CALLS["scoring"].format(j=X.NEEDS_JUDGE.replace("g_text", "(CASE WHEN series_uuid::BIGINT % 50 = 0 THEN regexp_replace(g_text, ' changed$', '') ELSE g_text END)"), w=""))}
  UNION ALL {_ASKED.format(run="second", extraction="0", matching="0", scoring="0")}
  UNION ALL {_ASKED.format(run="changed", **{k: v.format(n="", j=X.NEEDS_JUDGE, w=" AND series_uuid::BIGINT % 50 = 0" + (" AND ng > 0" if k == "extraction" else "")) for k, v in _CALLS.items()})}""")
def resumed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit from reports to the summary, once more over the same reports, and after a change of some: what each asks."""
    found = X.both_sides(spark, sf_dir)
    one = F.struct("pos", "text", "clinical_status", "clinical_significance", "laterality", "comparison", "measurements")
    of = lambda side: F.struct(F.lit(side).alias("side"), F.array_sort(F.collect_list(F.when(F.col("side") == side, one))).alias("own"))
    listed = stored_by_series(found.groupBy("series_uuid").agg(F.array(of("gt"), of("pred")).alias("both")).select("series_uuid", F.inline("both")), "reports")
    few = (F.col("series_uuid").cast("long") % 50 == 0) & (F.col("side") == "gt")
    changed = F.transform("own", lambda f, i: F.when(few & (i == 0), f.withField("text", F.concat(f["text"], F.lit(" changed")))).otherwise(f))
    report = lambda own: listed.select("series_uuid", "side", F.to_json(F.transform(own, lambda f: f.dropFields("pos"))).alias("text"))
    root, out = new_path(spark, "audit"), []
    for name, reports in (("first", report("own")), ("second", report("own")), ("changed", report(changed))):
        log = replies.ReplyLog(spark, f"{root}/log", name, 2000)
        done = runs.run(spark, f"{root}/store", reports, _stand_ins(log), log=log, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
        calls = log.calls().agg(*(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("calls"))), F.lit(0)).alias(f"{s}_calls") for s in ("extraction", "matching", "scoring")))
        count = lambda df, c: df.agg(F.count("*").alias(c))
        row = calls.crossJoin(done.summary.select("metadata.n_reports")).crossJoin(count(done.records, "n_records")).crossJoin(count(done.orphans, "n_orphans"))
        out.append(stored(row.select(F.lit(name).alias("run"), "*"), "calls"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""SELECT p.series_uuid, p.pred_id, p.gt_id, (CASE WHEN {X.NEEDS_JUDGE} THEN {" + ".join(f"(k % {w.split()[2]} = 0)::INT" for w, _, _ in X.TEXT_ERRORS)} ELSE 0 END)::INT AS n FROM pairs p""")
def scatter_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _judged(spark, sf_dir)
    answers = pairs.where("needs_judge").select("series_uuid", "pred_id", "gt_id", X.text_errors().alias("errors"))
    return J.scatter(pairs.select("series_uuid", "pred_id", "gt_id"), answers).select("series_uuid", "pred_id", "gt_id", F.size("errors").alias("n"))


# Rule judges: sentences are put together from words that the rules know.
_SENTENCES = {
    "side": "CASE k % 6 WHEN 0 THEN 'Left kidney cyst' WHEN 1 THEN 'Both lungs are clear' WHEN 2 THEN 'Fracture of a RIGHT rib' WHEN 3 THEN 'Effusion on the left and right' WHEN 4 THEN 'Lingula scar' ELSE 'Heart is large' END",
    "change": "CASE k % 7 WHEN 0 THEN 'New nodule, larger' WHEN 1 THEN 'Nodule has increased' WHEN 2 THEN 'Smaller effusion' WHEN 3 THEN 'Unchanged cyst' WHEN 4 THEN 'Effusion has cleared' WHEN 5 THEN 'stable but worse' ELSE 'Renewal of a cyst' END",
    "grade": "CASE ({x}) % 5 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' WHEN 2 THEN 'severe' WHEN 3 THEN 'small' ELSE 'plain' END || ' change'",
    "certainty": "CASE ({x}) % 6 WHEN 0 THEN 'edema' WHEN 1 THEN 'probable edema' WHEN 2 THEN 'possible edema' WHEN 3 THEN 'less likely edema' WHEN 4 THEN 'no definite edema' ELSE 'no edema' END",
    "findings": "'FINDINGS: Left cyst of 5 mm. No effusion of ' || CAST(k AS string) || '.' || chr(10) || 'IMPRESSION: Possible new mass'",
    "report": "CASE WHEN k % 4 = 0 THEN 'INDICATION: pain  in ' || name || chr(10) ELSE '' END || 'FINDINGS: Left cyst of 5 mm. No effusion of ' || name || '.' || chr(10) || 'IMPRESSION: Possible new mass'",
    "numbers": "CASE k % 4 WHEN 0 THEN 'A ' || CAST(k % 50 AS string) || ' mm cyst, ' || CAST(s % 90 AS string) || '% stenosis and ' || CAST(s % 40 AS string) || '.5 Hounsfield units in 3 places' WHEN 1 THEN 'Mass of ' || CAST(k % 50 AS string) || ' x ' || CAST(s % 90 AS string) || '.5 cm, formerly 7 cm' WHEN 2 THEN 'Decreased from 8 mm to ' || CAST(k % 50 AS string) || ' mm, SUV max ' || CAST(s % 40 AS string) || '.5' ELSE CAST(k % 50 AS string) || ' enlarged lymph nodes, aneurysm ' || CAST(s % 90 AS string) || ' cm above the bifurcation' END",
}


def _sentences(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return X.base(spark, sf_dir).selectExpr("CAST(o AS string) AS series_uuid", "n AS pos", *(f"{e} AS {c}" for c, e in columns.items()))


@query("SELECT o::VARCHAR AS series_uuid, n AS pos, CASE WHEN k % 4 = 0 THEN regexp_replace(trim('pain  in ' || name), '\\s+', ' ', 'g') ELSE '' END AS indication FROM base")
def indication_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, text=_SENTENCES["report"]).select("series_uuid", "pos", R.indication("text").alias("indication"))


@query("""SELECT o::VARCHAR || '.' || n AS series_uuid, i AS pos, CASE i WHEN 0 THEN 'abnormal' WHEN 1 THEN 'normal' ELSE 'abnormal' END AS clinical_status, CASE i WHEN 0 THEN 'left' END AS laterality, CASE i WHEN 2 THEN 'new' END AS comparison, (i = 0)::INT AS n_measurements
  FROM base, (SELECT unnest([0, 1, 2])::INT AS i)""")
def sentence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir, text=_SENTENCES["findings"]).select(F.concat_ws(".", "series_uuid", "pos").alias("series_uuid"), F.lit("gt").alias("side"), "text")
    return matcher.sentence_findings(rows).select("series_uuid", "pos", "clinical_status", "laterality", "comparison", F.size("measurements").alias("n_measurements"))


@query("SELECT o::VARCHAR AS series_uuid, n AS pos, CASE k % 6 WHEN 0 THEN 'left' WHEN 1 THEN 'bilateral' WHEN 2 THEN 'right' WHEN 3 THEN 'bilateral' WHEN 4 THEN 'left' END AS side FROM base")
def side_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, text=_SENTENCES["side"]).select("series_uuid", "pos", R.side("text").alias("side"))


@query("SELECT o::VARCHAR AS series_uuid, n AS pos, CASE k % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'worsening' WHEN 2 THEN 'improving' WHEN 3 THEN 'stable' WHEN 4 THEN 'resolved' WHEN 5 THEN 'worsening' END AS comparison FROM base")
def comparison_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, text=_SENTENCES["change"]).select("series_uuid", "pos", R.change("text").alias("comparison"))


@query("""SELECT series_uuid, pos, (i - 1)::INT AS i, m[i].value AS value, m[i].unit AS unit, m[i].category AS category FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT o::VARCHAR AS series_uuid, n AS pos, CASE k % 4
  WHEN 0 THEN [{'value': (k % 50)::DOUBLE, 'unit': 'mm', 'category': 'size'}, {'value': (s % 90)::DOUBLE, 'unit': 'pct', 'category': 'ratio'}, {'value': (s % 40) + 0.5::DOUBLE, 'unit': 'hu', 'category': 'attenuation'}]
  WHEN 1 THEN [{'value': (k % 50)::DOUBLE, 'unit': 'cm', 'category': 'size'}, {'value': (s % 90) + 0.5::DOUBLE, 'unit': 'cm', 'category': 'size'}]
  WHEN 2 THEN [{'value': (k % 50)::DOUBLE, 'unit': 'mm', 'category': 'size'}, {'value': (s % 40) + 0.5::DOUBLE, 'unit': NULL, 'category': 'other'}]
  ELSE [{'value': (k % 50)::DOUBLE, 'unit': NULL, 'category': 'count'}, {'value': (s % 90)::DOUBLE, 'unit': 'cm', 'category': 'other'}] END AS m FROM base))""")
def measurement_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, text=_SENTENCES["numbers"]).select("series_uuid", "pos", F.posexplode(R.numbers("text")).alias("i", "m")).select("series_uuid", "pos", "i", "m.value", "m.unit", "m.category")


@query("""SELECT series_uuid, pred_id, gt_id, round(j, 6) AS likeness FROM (SELECT *, rank() OVER (PARTITION BY series_uuid, pred_id ORDER BY crossed, j DESC) AS r FROM (SELECT p.series_uuid, p.finding_id AS pred_id, g.finding_id AS gt_id,
  coalesce((p.laterality <> g.laterality)::INT, 0) AS crossed, coalesce(len(list_intersect(p.t, g.t)) / nullif(len(list_distinct(list_concat(p.t, g.t))), 0), 0.0) AS j
  FROM (SELECT *, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS t FROM pred) p JOIN (SELECT *, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS t FROM gt) g ON p.series_uuid = g.series_uuid) WHERE j >= 0.3) WHERE r = 1""")
def lexical_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matcher.lexical_matches(X.findings(spark, sf_dir, "pred"), X.findings(spark, sf_dir, "gt"))
    return out.withColumn("likeness", F.round("likeness", 6))


_RANKS = "CASE ({x}) % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END"


@query(f"SELECT o::VARCHAR AS series_uuid, n AS pos, CASE WHEN d >= 2 THEN 'major' WHEN d = 1 THEN 'minor' END AS severity FROM (SELECT o, n, abs({_RANKS.format(x='k')} - {_RANKS.format(x='s')}) AS d FROM base)")
def certainty_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir, p=_SENTENCES["certainty"].format(x="k"), g=_SENTENCES["certainty"].format(x="s"))
    return rows.select("series_uuid", "pos", R.certainty_severity("p", "g").alias("severity"))


_GRADES = "CASE ({x}) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 END"


@query(f"SELECT o::VARCHAR AS series_uuid, n AS pos, CASE WHEN g IS NULL THEN NULL WHEN p IS NULL THEN CASE WHEN g = 3 THEN 'major' ELSE 'minor' END WHEN abs(p - g) >= 2 THEN 'major' WHEN abs(p - g) = 1 THEN 'minor' END AS severity FROM (SELECT o, n, {_GRADES.format(x='k')} AS p, {_GRADES.format(x='s')} AS g FROM base)")
def grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir, p=_SENTENCES["grade"].format(x="k"), g=_SENTENCES["grade"].format(x="s"))
    return rows.select("series_uuid", "pos", R.grade_severity("p", "g").alias("severity"))
