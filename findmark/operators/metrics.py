"""Outcome counts and tier metrics, for any scope.

``records`` hold one row per scored link (``schema``: keys, series_uuid, pred_id, gt_id, category, gt_sig, pred_sig, errors);
``orphans`` one per finding without a link (keys, series_uuid, side, finding_id, clinical_status, clinical_significance).
A scope is a list of key columns: none for the whole set, the series, or a subset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmark import schema
from findmark.functions import normalize as N

_FLAGS = ("fn_mis", "fn_inc", "fp_spu", "fp_inc", "findings_at_stake", "recall_hits", "recall_total", "precision_hits", "precision_total")


def gt_outcomes(records: DataFrame, keys: list[str] = []) -> DataFrame:
    """Per reference finding: a hit if any link is not INC; its significance and those of its candidates."""
    inc = F.col("category") == "INC"
    return records.groupBy(*keys, "series_uuid", "gt_id").agg(F.bool_or(~inc).alias("hit"), F.bool_and(inc).alias("all_inc"), F.first("gt_sig").alias("sig"), F.collect_set("pred_sig").alias("other_sigs"))


def pred_outcomes(records: DataFrame, keys: list[str] = []) -> DataFrame:
    return records.groupBy(*keys, "series_uuid", "pred_id").agg(F.bool_or(F.col("category") != "INC").alias("hit"), F.first("pred_sig").alias("sig"))


def contradicted(records: DataFrame, keys: list[str] = []) -> DataFrame:
    """Candidates whose links are all INC and touch no reference finding that is all INC."""
    inc = F.col("category") == "INC"
    lost = F.bool_and(inc).over(Window.partitionBy(*keys, "series_uuid", "gt_id"))
    return records.withColumn("lost", lost).groupBy(*keys, "series_uuid", "pred_id").agg(F.bool_and(inc).alias("inc"), F.bool_or("lost").alias("lost"), F.first("pred_sig").alias("sig")).where("inc AND NOT lost").drop("inc", "lost")


def muc_counts(records: DataFrame, orphans: DataFrame, keys: list[str] = []) -> DataFrame:
    """The five outcome counts: each reference finding by its best link; all orphans count, errors or not."""
    rank = F.when(F.col("category") == "COR", 3).when(F.col("category") == "PAR", 2).otherwise(1)
    best = records.groupBy(*keys, "series_uuid", "gt_id").agg(F.max(rank).alias("r"))
    hits = best.select(*keys, *((F.col("r") == r).cast("long").alias(c) for c, r in (("COR", 3), ("PAR", 2), ("INC", 1))), F.lit(0).cast("long").alias("MIS"), F.lit(0).cast("long").alias("SPU"))
    rest = orphans.select(*keys, *(F.lit(0).cast("long").alias(c) for c in ("COR", "PAR", "INC")), (F.col("side") == "gt").cast("long").alias("MIS"), (F.col("side") == "pred").cast("long").alias("SPU"))
    return hits.unionByName(rest).groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in schema.OUTCOMES))


def distinct_findings(records: DataFrame, orphans: DataFrame, keys: list[str] = []) -> DataFrame:
    """Distinct linked findings of both sides, and with the orphans."""
    one = lambda side: records.select(*keys, F.lit(side).alias("side"), "series_uuid", F.col(f"{side}_id").alias("finding_id"))
    linked = one("gt").union(one("pred")).distinct().withColumn("linked", F.lit(1))
    rest = orphans.select(*keys, "side", "series_uuid", "finding_id").withColumn("linked", F.lit(0))
    count = lambda side, only: F.sum(F.when((F.col("side") == side) & (F.col("linked") == 1 if only else F.lit(True)), 1).otherwise(0))
    return linked.union(rest).groupBy(*keys).agg(count("pred", True).alias("evaluated_pred"), count("gt", True).alias("evaluated_gt"), count("pred", False).alias("total_pred"), count("gt", False).alias("total_gt"))


def _code(sig: str) -> Column:
    """A significance as a power of two, zero for any other value."""
    return reduce(lambda out, i: F.when(F.col(sig) == schema.SIGNIFICANCE[i], 1 << i).otherwise(out), range(len(schema.SIGNIFICANCE)), F.lit(0))


def _events(records: DataFrame, orphans: DataFrame, keys: list[str]) -> DataFrame:
    """What tiers count, one row per finding: kind, significance, hit, all_inc, whether contradicted, and the other side's
    significances; those are bits, so that findings are counted without sorting them and without lists.

    A finding has one significance on all of its links.
    """
    inc, n = F.col("category") == "INC", F.lit(0)
    own = list(dict.fromkeys([*keys, "series_uuid"]))
    rows = records.select(*own, "gt_id", "pred_id", inc.alias("inc"), _code("gt_sig").alias("gt_code"), _code("pred_sig").alias("pred_code"))
    event = lambda df, kind, code, hit, lost, contra, other: df.select(*keys, F.lit(kind).alias("kind"), code.alias("code"), hit.alias("hit"), lost.alias("all_inc"), contra.alias("contra"), other.alias("others"))
    f, inc = F.lit(False), F.col("inc")
    by_gt = rows.groupBy(*own, "gt_id").agg(F.bool_or(~inc).alias("hit"), F.bool_and(inc).alias("all_inc"), F.max("gt_code").alias("code"), F.bit_or("pred_code").alias("others"))
    gt = event(by_gt, "gt", F.col("code"), F.col("hit"), F.col("all_inc"), f, F.col("others"))
    lost = rows.withColumn("lost", F.bool_and(inc).over(Window.partitionBy(*own, "gt_id")))
    by_pred = lost.groupBy(*own, "pred_id").agg(F.bool_or(~inc).alias("hit"), (F.bool_and(inc) & ~F.bool_or("lost")).alias("contra"), F.max("pred_code").alias("code"))
    pred = event(by_pred, "pred", F.col("code"), F.col("hit"), f, F.col("contra"), n)
    code = _code("clinical_significance")
    mis = event(orphans.where((F.col("side") == "gt") & N.is_missed()), "missed", code, f, f, f, n)
    spu = event(orphans.where((F.col("side") == "pred") & N.is_unsupported()), "unsupported", code, f, f, f, n)
    return gt.unionByName(pred).unionByName(mis).unionByName(spu)


def _flags(pool: tuple[str, ...]) -> dict[str, Column]:
    kind, bits = F.col("kind"), sum(1 << schema.SIGNIFICANCE.index(s) for s in pool)
    inside, claimed = (F.col(c).bitwiseAND(F.lit(bits)) != 0 for c in ("code", "others"))
    gt, lost, contra = kind == "gt", F.col("all_inc"), F.col("contra")
    missed, spu, pred = (kind == k for k in ("missed", "unsupported", "pred"))
    tests = {
        "fn_mis": missed & inside,
        "fn_inc": gt & lost & inside,
        "fp_spu": spu & inside,
        "fp_inc": (gt & lost & ~inside & claimed) | (contra & inside),
        "findings_at_stake": (gt & (inside | claimed)) | ((missed | spu | contra) & inside),
        "recall_hits": gt & inside & F.col("hit"),
        "recall_total": (gt | missed) & inside,
        "precision_hits": pred & inside & F.col("hit"),
        "precision_total": (pred | spu) & inside,
    }
    return {f: F.coalesce(tests[f], F.lit(False)).cast("long") for f in _FLAGS}


def tier_counts(records: DataFrame, orphans: DataFrame, keys: list[str] = []) -> DataFrame:
    """The nine counts of each scope and tier that occur; one pass over the findings, one aggregation.

    Findings of a larger scope are counted by kind first, and tiers are told for the few kinds.
    """
    events = _events(records, orphans, keys)
    if "series_uuid" in keys:
        kinds = events.withColumn("n", F.lit(1).cast("long"))
    else:
        kinds = events.groupBy(*events.columns).agg(F.count("*").alias("n"))
    sums = {t: {f: F.sum(flag * F.col("n")).alias(f"{t}_{f}") for f, flag in _flags(pool).items()} for t, pool in schema.TIERS.items()}
    # a row for each scope moves, not one for each of its tiers
    wide = kinds.groupBy(*keys).agg(F.count("*").alias("n_events"), *(x for own in sums.values() for x in own.values())).where("n_events > 0")
    tiers = F.array(*(F.struct(F.lit(t).alias("tier"), *(F.col(f"{t}_{f}").alias(f) for f in _FLAGS)) for t in schema.TIERS))
    return wide.select(*keys, F.inline(tiers))


def with_rates(counts: DataFrame) -> DataFrame:
    """Counts with sums and rates: recall and precision are null on an empty pool, errors per finding are then zero."""
    out = counts.withColumn("fn", F.col("fn_mis") + F.col("fn_inc")).withColumn("fp", F.col("fp_spu") + F.col("fp_inc")).withColumn("errors", F.col("fn") + F.col("fp"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return out.withColumn("errors_per_finding", F.coalesce(rate("errors", "findings_at_stake"), F.lit(0.0))).withColumn("recall", rate("recall_hits", "recall_total")).withColumn("precision", rate("precision_hits", "precision_total"))


def every_tier(scopes: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for every scope of ``scopes`` and every tier, zeros where nothing was counted."""
    full = scopes.select(*keys).withColumn("t", F.explode(N.tiers())).select(*keys, F.col("t.tier").alias("tier"))
    return full.join(counts, [*keys, "tier"], "left").fillna(0, list(_FLAGS))


def tier_metrics(records: DataFrame, orphans: DataFrame, keys: list[str] = [], scopes: DataFrame | None = None) -> DataFrame:
    counts = tier_counts(records, orphans, keys)
    return with_rates(counts if scopes is None else every_tier(scopes, counts, keys))


def per_report_rates(metrics: DataFrame, n_reports: Column) -> DataFrame:
    out = metrics
    for c in ("errors", "fn", "fp"):
        out = out.withColumn(f"{c}_per_report", F.coalesce(F.col(c) / F.nullif(n_reports, F.lit(0)), F.lit(0.0)))
    return out


def by_subset(records: DataFrame, orphans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records by the reference finding's subsets, orphans by their own; a row stands in each of its subsets."""
    return records.withColumn("subset", F.explode("gt_subsets")), orphans.withColumn("subset", F.explode("subsets"))


def attribute_breakdown(records: DataFrame, keys: list[str] = []) -> DataFrame:
    """Each dimension's clean, minor and major records; of several errors on a dimension the worst counts."""
    # a record's dimensions are bits of two numbers, so a row for each of them is made of the sums alone
    code = lambda e: reduce(lambda out, i: F.when(e["dimension"] == schema.DIMENSIONS[i], 1 << i).otherwise(out), range(len(schema.DIMENSIONS)), F.lit(0))
    of = lambda c, s: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0), lambda bits, e: F.when(e["severity"] == s, bits.bitwiseOR(code(e))).otherwise(bits))).otherwise(0)
    rows = records.select(*keys, *(of("structured_errors", s).bitwiseOR(of("text_errors", s)).alias(s) for s in ("major", "minor")))
    rows = rows.withColumn("minor", F.col("minor").bitwiseAND(F.bitwise_not("major")))
    sums = [F.sum((F.col(s).bitwiseAND(F.lit(1 << i)) != 0).cast("long")).alias(f"{s}_{i}") for i in range(len(schema.DIMENSIONS)) for s in ("major", "minor")]
    wide = rows.groupBy(*keys).agg(F.count("*").alias("evaluated"), *sums).where("evaluated > 0")
    one = lambda i, d: F.struct(F.lit(d).alias("dimension"), (F.col("evaluated") - F.col(f"minor_{i}") - F.col(f"major_{i}")).alias("clean"), F.col(f"minor_{i}").alias("minor"), F.col(f"major_{i}").alias("major"), F.col("evaluated").alias("evaluated"))
    out = wide.select(*keys, F.inline(F.array(*(one(i, d) for i, d in enumerate(schema.DIMENSIONS)))))
    for c in ("clean", "minor", "major"):
        out = out.withColumn(f"{c}_pct", F.col(c) / F.col("evaluated"))
    return out


def extraction_stats(attempts: DataFrame) -> DataFrame:
    """Per side, from ``attempts(series_uuid, side, state, n_findings)``: how many were processed, skipped and failed."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = attempts.groupBy("side").agg(F.count("*").alias("total"), n("processed").alias("processed"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("state") == "processed", F.col("n_findings"))), F.lit(0)).alias("findings"))
    return out.withColumn("findings_per_report", F.coalesce(F.col("findings") / F.nullif("processed", F.lit(0)), F.lit(0.0)))


def matching_stats(status: DataFrame) -> DataFrame:
    """From ``status(series_uuid, failed, n_matches, n_unmatched_pred, n_unmatched_gt, retries, validation_fallback)``."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.removeprefix("n_"))
    return status.agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failed"), s("n_matches"), s("n_unmatched_pred"), s("n_unmatched_gt"), s("retries"), F.count_if("validation_fallback").alias("fallbacks"))


def indication_stats(indications: DataFrame) -> DataFrame:
    """From ``indications(series_uuid, indication)``, null where it failed."""
    i = F.col("indication")
    return indications.agg(F.count_if(i.isNotNull()).alias("processed"), F.count_if(i.isNull()).alias("failed"), F.count_if(F.length(i) > 0).alias("non_empty"), F.count_if(F.length(i) == 0).alias("empty"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals of ``usage(model, uncached_input, cache_read, cache_write, output)`` and their price in dollars.

    ``prices(model, input, output, cached_input)`` are by a million tokens; writing to a cache costs a quarter more than
    input, reading defaults to the input's price, and a model without a price costs nothing.
    """
    kinds = ("uncached_input", "cache_read", "cache_write", "output")
    sums = usage.groupBy(F.lower(F.trim("model")).alias("model")).agg(*(F.sum(k).alias(k) for k in kinds), F.count("*").alias("calls"))
    own = prices.select(F.lower(F.trim("model")).alias("model"), F.col("input").alias("in_price"), F.col("output").alias("out_price"), F.coalesce("cached_input", "input").alias("read_price"))
    cost = (F.col("uncached_input") * F.col("in_price") + F.col("cache_read") * F.col("read_price") + F.col("cache_write") * F.col("in_price") * 1.25 + F.col("output") * F.col("out_price")) / 1e6
    rows = sums.join(own, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0)))
    return rows.agg(F.sum("calls").alias("calls"), F.sum(F.col("uncached_input") + F.col("cache_read") + F.col("cache_write")).alias("prompt_tokens"), F.sum("output").alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("token_cost"))


def coverage(expected: DataFrame, scored: DataFrame, failures: DataFrame) -> DataFrame:
    """Expected, scored and missing series, those that scoring lost, and those that were lost before."""
    n = lambda df, c: df.select("series_uuid").distinct().agg(F.count("*").alias(c))
    out = n(expected, "expected").crossJoin(n(scored, "scored")).crossJoin(n(failures, "failed_in_scoring"))
    out = out.withColumn("missing", F.col("expected") - F.col("scored"))
    return out.withColumn("dropped_earlier", F.greatest(F.lit(0).cast("long"), F.col("missing") - F.col("failed_in_scoring")))
