"""Findings and links from texts, by rules alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmark.functions import normalize as N
from findmark.functions import rules as R
from findmark.sources.scratch import stored


def sentence_findings(reports: DataFrame) -> DataFrame:
    """Each sentence of ``reports(series_uuid, side, text)`` as a finding, all its fields read from its words."""
    rows = reports.select("series_uuid", "side", F.posexplode(R.sentences("text")).alias("pos", "text"))
    return rows.select(
        "series_uuid", "side", "pos", N.finding_id("series_uuid", "pos").alias("finding_id"), "text", R.status("text").alias("clinical_status"),
        F.lit("routine").alias("clinical_significance"), R.side("text").alias("laterality"), R.change("text").alias("comparison"), R.numbers("text").alias("measurements"),
    )


#: Pairs of findings of a series up to which all are compared; larger series are joined by rare words, with the same result.
LARGE = 10_000


def _all_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    return a.join(b, "series_uuid").withColumn("likeness", R.likeness("p", "g")).where(F.col("likeness") >= least)


def _by_rare_words(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """The same by a prefix join.

    Words of a series stand in order of rarity.  Two sets that are alike by ``least`` share a word among the first
    ``n - ceil(least * n) + 1`` of each, so only these are joined; a pair is dropped before the exact comparison where its
    sizes, or the words behind the shared one, cannot make it alike enough.  Findings of the same words are compared once.
    """
    sets = lambda df, x: df.select("series_uuid", F.array_sort(x).alias("w")).where("size(w) > 0").distinct()
    own = {"p": sets(a, "p"), "g": sets(b, "g")}
    counts = own["p"].unionByName(own["g"]).select("series_uuid", F.explode("w").alias("word")).groupBy("series_uuid", "word").agg(F.count("*").alias("n"))
    least_ = F.lit(float(least))

    def prefix(df: DataFrame, x: str) -> DataFrame:
        ranked = df.select("series_uuid", "w", F.explode("w").alias("word")).join(counts, ["series_uuid", "word"])
        place = Window.partitionBy("series_uuid", "w").orderBy("n", "word")
        ranked = ranked.withColumn("i", F.row_number().over(place)).withColumn("size", F.size("w"))
        # a word more than needed, so that no rounding of the product loses one
        kept = F.col("size") - F.ceil(least_ * F.col("size") - F.lit(1e-9)) + 1
        return ranked.where(F.col("i") <= kept).select("series_uuid", "word", F.col("w").alias(f"{x}_w"), F.col("i").alias(f"{x}_i"), F.col("size").alias(f"{x}_n"))

    met = prefix(own["p"], "p").join(prefix(own["g"], "g"), ["series_uuid", "word"])
    needed = least_ / (1 + least_) * (F.col("p_n") + F.col("g_n")) - F.lit(1e-9)
    # the first shared word of a pair: all that it can share is that one and what follows on both sides
    first = met.groupBy("series_uuid", "p_w", "g_w", "p_n", "g_n").agg(F.min(F.struct("p_i", "g_i")).alias("at"))
    rest = 1 + F.least(F.col("p_n") - F.col("at.p_i"), F.col("g_n") - F.col("at.g_i"))
    sized = (F.col("g_n") >= least_ * F.col("p_n") - F.lit(1e-9)) & (F.col("p_n") >= least_ * F.col("g_n") - F.lit(1e-9))
    alike = first.where(sized & (rest >= needed)).withColumn("likeness", R.likeness("p_w", "g_w")).where(F.col("likeness") >= least).select("series_uuid", "p_w", "g_w", "likeness")
    return a.withColumn("p_w", F.array_sort("p")).join(alike, ["series_uuid", "p_w"]).join(b.withColumn("g_w", F.array_sort("g")), ["series_uuid", "g_w"]).drop("p_w", "g_w")


def lexical_matches(pred: DataFrame, gt: DataFrame, least: float = 0.3, large: int = LARGE) -> DataFrame:
    """Links of findings of a series by shared words: each candidate takes its likest reference findings (ties all), of its
    own side if one of that side is like enough, else of another.

    Series of more than ``large`` pairs, if any, go through ``_by_rare_words``; with ``least`` of zero, where findings without a
    shared word are alike, all pairs are compared.
    """
    a = pred.select("series_uuid", F.col("finding_id").alias("pred_id"), F.col("laterality").alias("p_side"), R.tokens("text").alias("p"))
    b = gt.select("series_uuid", F.col("finding_id").alias("gt_id"), F.col("laterality").alias("g_side"), R.tokens("text").alias("g"))
    sizes = lambda df, n: df.groupBy("series_uuid").agg(F.count("*").alias(n))
    big = sizes(pred, "n").join(sizes(gt, "m"), "series_uuid").where(F.col("n") * F.col("m") > large).select("series_uuid")
    if least <= 0 or (big := stored(big, "large")).isEmpty():
        both = _all_pairs(a, b, least)
    else:
        part = lambda df, how: df.join(big, "series_uuid", how)
        rare = _by_rare_words(part(a, "left_semi"), part(b, "left_semi"), least)
        both = _all_pairs(part(a, "left_anti"), part(b, "left_anti"), least).unionByName(rare)
    cross = F.col("p_side").isNotNull() & F.col("g_side").isNotNull() & (F.col("p_side") != F.col("g_side"))
    w = Window.partitionBy("series_uuid", "pred_id").orderBy(cross.cast("int"), F.desc("likeness"))
    return both.withColumn("r", F.rank().over(w)).where("r = 1").select("series_uuid", "pred_id", "gt_id", "likeness")
