"""Queries of a results explorer over the scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findmark import schema
from findmark.functions import normalize as N
from findmark.functions import outcomes as K
from findmark.sources.scratch import stored


def report_index(per_report: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per series: errors by tier, outcome counts, and the distinct values of both sides' findings."""
    tiers = per_report.groupBy("series_uuid").agg(*(F.max(F.when(F.col("tier") == t, F.col("errors"))).alias(f"{t}_errors") for t in schema.TIERS), *(F.first(c).alias(f"muc_{c}") for c in schema.OUTCOMES))
    each = findings.select("series_uuid", "clinical_significance", "comparison", F.explode_outer(F.transform("measurements", lambda m: m["category"])).alias("category"))
    values = each.groupBy("series_uuid").agg(*(F.sort_array(F.collect_set(c)).alias(n) for c, n in (("clinical_significance", "significances"), ("category", "categories"), ("comparison", "comparisons"))))
    out = tiers.join(values, "series_uuid", "left")
    none = F.array().cast("array<string>")
    for c in ("significances", "categories", "comparisons"):
        out = out.withColumn(c, F.coalesce(c, none))
    return out


def filter_index(index: DataFrame, significances: list[str] = [], categories: list[str] = [], comparisons: list[str] = [], outcomes: list[str] = [], tier: str = "all", least: int = 0, most: int | None = None) -> DataFrame:
    """Rows that have every chosen value and outcome, and errors of the tier within the range."""
    out = index
    for column, chosen in (("significances", significances), ("categories", categories), ("comparisons", comparisons)):
        if chosen:
            out = out.where(F.size(F.array_except(F.array(*map(F.lit, chosen)), column)) == 0)
    for c in outcomes:
        out = out.where(F.col(f"muc_{c}") > 0)
    out = out.where(F.col(f"{tier}_errors") >= least)
    return out if most is None else out.where(F.col(f"{tier}_errors") <= most)


def search_text(findings: DataFrame, text: str) -> DataFrame:
    """Series with the trimmed, lower-cased text in a finding of either side; an empty one keeps all."""
    wanted = text.strip().lower()
    rows = findings if not wanted else findings.where(F.contains(F.lower("text"), F.lit(wanted)))
    return rows.select("series_uuid").distinct()


#: Rarest trigrams of a text that are looked up.
MOST_GRAMS = 4
#: Tables of a text index.
_INDEX = {
    "texts": "text_id binary, text string, homes array<int>, bucket int", "series": "text_id binary, series_uuid string, bucket int",
    "postings": "text_id binary, home int, gram string, bucket int", "grams": "gram string, at int, n bigint",
}


def _text_id(text: Column | str) -> Column:
    """16 bytes of a text's SHA-256: findings of the same text share it."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _trigrams(text: Column | str) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def write_text_index(findings: DataFrame, path: str, buckets: int = 64) -> None:
    """An index of the findings' lower-cased texts: each different text once, with the buckets of its series; the texts of each
    series; postings of the texts by trigram, and how many texts each trigram has.

    A text that many findings share moves once for each of its series, and its trigrams once.  Postings of a trigram lie in one
    bucket, dealt over several files by texts, so a frequent one is no task's alone.
    """
    spark = findings.sparkSession
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    rows = findings.where("text is not null").select("series_uuid", F.lower("text").alias("text"))

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")
        return spark.read.schema(_INDEX[name]).parquet(f"{path}/{name}")

    own = rows.select(_text_id("text").alias("text_id"), "series_uuid", bucket("series_uuid").alias("bucket"))
    write(own.repartition("bucket").dropDuplicates(["bucket", "series_uuid", "text_id"]), "series")
    places = rows.select("text", bucket("series_uuid").alias("home")).groupBy("text").agg(F.collect_set("home").alias("homes"))
    texts = write(places.select(_text_id("text").alias("text_id"), "text", "homes").withColumn("bucket", bucket("text_id")).repartition("bucket"), "texts")
    postings = texts.select("text_id", F.col("bucket").alias("home"), F.explode(_trigrams("text")).alias("gram")).withColumn("bucket", bucket("gram"))
    postings = write(postings.repartition("bucket", F.pmod(F.xxhash64("text_id"), F.lit(4))).sortWithinPartitions("bucket", "gram"), "postings")
    postings.groupBy("gram", F.col("bucket").alias("at")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/grams")


def search_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """``search_text`` over an index: only the buckets of the text's rarest trigrams are read, then those of the texts that have
    all of these, and of their series.  A text of one or two characters has no trigram and is looked for in all texts."""
    table = lambda name: spark.read.schema(_INDEX[name]).parquet(f"{path}/{name}")
    wanted, texts, series = text.strip().lower(), table("texts"), table("series")
    if not wanted:
        return series.select("series_uuid").distinct()
    grams = list({wanted[i : i + 3]: None for i in range(len(wanted) - 2)})
    if grams:
        found = table("grams").where(F.col("gram").isin(grams)).orderBy("n", "gram").collect()  # at most as many as the text has
        if len(found) < len(grams):
            return series.select("series_uuid").where("false")
        rarest = found[:MOST_GRAMS]
        hits = table("postings").where(F.col("bucket").isin([r["at"] for r in rarest]) & F.col("gram").isin([r["gram"] for r in rarest]))
        hits = stored(hits.groupBy("text_id", "home").agg(F.count("*").alias("n")).where(F.col("n") >= len(rarest)), "candidates")
        homes = [r["home"] for r in hits.select("home").distinct().collect()]  # at most the index's buckets
        texts = texts.where(F.col("bucket").isin(homes)).join(hits, "text_id", "left_semi")
    hits = stored(texts.where(F.contains("text", F.lit(wanted))).select("text_id", "homes"), "hits")
    homes = [r["home"] for r in hits.select(F.explode("homes").alias("home")).distinct().collect()]  # at most the index's buckets
    return series.where(F.col("bucket").isin(homes)).join(hits, "text_id", "left_semi").select("series_uuid").distinct()


def report_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("series_uuid")
    for t in tables[1:]:
        out = out.union(t.select("series_uuid"))
    return out.distinct()


def limit_series(reports: DataFrame, n: int) -> DataFrame:
    """The first ``n`` series by name, as a top-k, not a full sort."""
    return reports.select("series_uuid").distinct().orderBy("series_uuid").limit(n)


def display_category(structured: Column, text: Column, found: Column) -> Column:
    """As shown: without the rule for certainty on critical findings."""
    return K.effective(found, structured, text, None)


def _status(findings: DataFrame, *keys: str) -> DataFrame:
    """What filters and impacts need of findings."""
    return findings.select(*keys, "clinical_status", N.subsets().alias("subsets"))


def match_index(records: DataFrame, orphans: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per finding and side with its best shown category and its counterparts.

    With ``findings`` rows have their ``clinical_status`` and ``subsets``, too; orphans are whole findings then.  Each side is
    joined with its own findings before the sides are put together, so rows of tables in buckets by series stay where they are.
    """
    shown = records.withColumn("shown", display_category(F.col("structured_errors"), F.col("text_errors"), F.col("muc_category")))
    rank = F.when(F.col("shown") == "COR", 3).when(F.col("shown") == "PAR", 2).otherwise(1)
    name = F.when(F.col("r") == 3, "COR").when(F.col("r") == 2, "PAR").otherwise("INC")

    def side(own: str, other: str, sig: str, other_sig: str) -> DataFrame:
        g = shown.groupBy("series_uuid", F.lit(own).alias("side"), F.col(f"{own}_id").alias("finding_id")).agg(F.max(rank).alias("r"), F.first(sig).alias("sig"), F.sort_array(F.collect_list(F.struct(F.col(f"{other}_id").alias("id"), "shown", F.col(other_sig).alias("sig")))).alias("counterparts"))
        g = g.withColumn("category", name).drop("r")
        return g if findings is None else g.join(_status(findings.where(F.col("side") == own), "series_uuid", "finding_id"), ["series_uuid", "finding_id"])

    none = F.array().cast("array<struct<id:string,shown:string,sig:string>>")
    rest = orphans.select("series_uuid", "side", "finding_id", F.col("clinical_significance").alias("sig"), none.alias("counterparts"), F.when(F.col("side") == "gt", "MIS").otherwise("SPU").alias("category"), *(() if findings is None else ("clinical_status", N.subsets().alias("subsets"))))
    return side("gt", "pred", "gt_sig", "pred_sig").unionByName(side("pred", "gt", "pred_sig", "gt_sig")).unionByName(rest)


def _told(index: DataFrame, findings: DataFrame | None) -> DataFrame:
    """An index with status and subsets: its own, where it was made with findings, else those of ``findings``."""
    keys = ["series_uuid", "side", "finding_id"]
    return index if findings is None else index.join(_status(findings, *keys), keys)


def filter_findings(index: DataFrame, findings: DataFrame | None, subset: str | None = None, tier: str = "all") -> DataFrame:
    """Findings of a subset that are errors of a tier: orphans in its pool, or with an INC link that has a side in it.

    ``findings`` may be left out for an index that was made with them.
    """
    rows = _told(index, findings)
    if subset is not None:
        rows = rows.where(F.array_contains("subsets", subset))
    if tier != "all":
        pool = schema.TIERS[tier]
        inside = F.col("sig").isin(*pool)
        orphan = F.col("category").isin("MIS", "SPU") & inside & ((F.col("category") == "MIS") | N.is_unsupported())
        wrong = F.exists("counterparts", lambda c: (c["shown"] == "INC") & (inside | c["sig"].isin(*pool)))
        rows = rows.where(orphan | wrong)
    return rows.select(*(c for c in index.columns if c not in ("clinical_status", "subsets")))


def finding_impact(index: DataFrame, findings: DataFrame | None, tier: str) -> DataFrame:
    """What each finding adds to a tier's FN, FP, recall hits and precision hits; null where it cannot count.

    ``findings`` may be left out for an index that was made with them.
    """
    pool = schema.TIERS[tier]
    rows = _told(index, findings)
    gt, inside, hit = F.col("side") == "gt", F.col("sig").isin(*pool), F.col("category").isin("COR", "PAR")
    claimed = F.exists("counterparts", lambda c: c["sig"].isin(*pool))
    silent = (F.col("category") == "SPU") & ~N.is_unsupported()
    return rows.select(
        "series_uuid", "side", "finding_id",
        F.when(gt & inside, (~hit).cast("int")).alias("fn"),
        F.when(gt & ~inside, ((F.col("category") == "INC") & claimed).cast("int")).when(~gt & (F.col("category") == "SPU") & ~silent & inside, 1).alias("fp"),
        F.when(gt & inside, hit.cast("int")).alias("recall_hit"),
        F.when(~gt & inside & ~silent, hit.cast("int")).alias("precision_hit"),
    )


def pair_error_table(records: DataFrame) -> DataFrame:
    """Ten rows per pair: the worst severity on each dimension and the reasoning of the first error of it."""
    rows = records.select("series_uuid", "pred_id", "gt_id", "structured_errors", "text_errors", F.explode(F.array(*map(F.lit, schema.DIMENSIONS))).alias("dimension"))

    def first(errors: str, severity: str) -> Column:
        own = F.filter(errors, lambda e: (e["dimension"] == F.col("dimension")) & (e["severity"] == severity))
        return F.try_element_at(own, F.lit(1))["reasoning"]

    of = lambda severity: F.coalesce(first("structured_errors", severity), first("text_errors", severity))
    has = lambda severity: F.exists("structured_errors", lambda e: (e["dimension"] == F.col("dimension")) & (e["severity"] == severity)) | F.exists("text_errors", lambda e: (e["dimension"] == F.col("dimension")) & (e["severity"] == severity))
    severity = F.when(has("major"), "major").when(has("minor"), "minor").otherwise("clean")
    return rows.select("series_uuid", "pred_id", "gt_id", "dimension", severity.alias("severity"), F.when(has("major"), of("major")).otherwise(of("minor")).alias("reasoning"))


def outcome_distribution(counts: DataFrame) -> DataFrame:
    """The five counts as rows with their percentage of the sum, zero if there is none."""
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in schema.OUTCOMES))).alias("x")).select("x.*")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("pct", F.coalesce(100 * F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def attribute_distribution(breakdown: DataFrame) -> DataFrame:
    rows = breakdown.select("dimension", "evaluated", F.explode(F.array(*(F.struct(F.lit(c).alias("severity"), F.col(c).alias("n")) for c in ("clean", "minor", "major")))).alias("x"))
    return rows.select("dimension", "x.severity", "x.n", F.coalesce(100 * F.col("x.n") / F.nullif("evaluated", F.lit(0)), F.lit(0.0)).alias("pct"))


def label(finding_id: Column | str, side: Column | str) -> Column:
    """``GT01`` or ``Pred12`` from an id's last part."""
    n = F.substring_index(finding_id, "_", -1).cast("int").cast("string")
    return F.concat(F.when(side == "gt" if isinstance(side, Column) else F.col(side) == "gt", "GT").otherwise("Pred"), F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")))


def rate_label(hits: str, total: str) -> Column:
    """A percentage with one decimal and its counts; a dash on an empty pool."""
    return F.when(F.col(total) > 0, F.format_string("%.1f%% (%d / %d)", 100.0 * F.col(hits) / F.col(total), F.col(hits), F.col(total))).otherwise(F.lit("—"))
