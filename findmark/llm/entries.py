"""Queries of the numbered operators, with their production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmark.llm import chat_format, complement_packing, hard_negatives, langid, line_rules, mixing, packing, passages, quality_gam, rans_tokens, simhash, topk, whitening

BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pairwise_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_gam.learn(docs, _table(spark, sf_dir, "labels").where(quality_gam.fold(5) != 0))
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", (quality_gam.fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_typed_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') AS t(conv_id, turn, role, text)")
    messages = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat_format.format_chats(messages.withColumn("parts", chat_format.text_part("text")))
    return chat_format.digests(chat_format.read_chats(formatted))


def op3_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_tokens.token_digests(spark, rans_tokens.write_token_ids(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_popcount_grid_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op8_term_at_a_time_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.whole_weights("embedding").alias("weights"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.weighted(_table(spark, sf_dir, "documents"), budget=mixing.BUDGET, most_rounds=mixing.STATED_ROUNDS, close=None)
    sampled = mixing.chance(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))) < F.col("probability")
    return out.select("row.doc_id", "topic", "tokens", F.round("probability", 4).alias("probability"), sampled.alias("sampled"))


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement_packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op12_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), topk.whole_weights("embedding").alias("weights"))
    out = hard_negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90)
    return out.drop("positive_rank")


def op13_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    return whitening.whitened(rows.select("vec_id", whitening.whole_entries("embedding", 64, 1_000_000).alias("x")), components=32)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pairwise_additive_quality, op2_typed_chat_format, op3_rans_token_ids, op4_line_frequency_rules, op5_chained_passages, op6_min_slack_packing, op7_popcount_grid_simhash, op8_term_at_a_time_topk, op9_raked_mixture, op10_rank_order_language, op11_exact_complement_packing, op12_angular_hard_negatives, op13_polarised_whitening)}


_TURNS = """WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_typed_chat_format": f"""{_TURNS}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.TURN + chat_format.BODY + chat_format.END)} + length(replace(role, '<|', '<||')) + length(replace(text, '<|', '<||')))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
        "op4_line_frequency_rules": line_rules.ORACLE_SQL,
        "op8_term_at_a_time_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
        "op12_angular_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.w) + 1), lambda i: a.w[i] * b.w[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 10""",
        "op9_raked_mixture": mixing.oracle_sql(mixing.STATED_ROUNDS, mixing.BUDGET),
    }
