"""Scoring of linked findings, from user tables to records and a summary.

``findings`` holds both sides (``schema.FINDING``), ``matches`` the links (series_uuid, pred_id, gt_id; further columns stay).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmark.functions import comparators as C
from findmark.functions import normalize as N
from findmark.functions import outcomes as K
from findmark.operators import judge, links, metrics
from findmark.sources.scratch import stored, stored_by_series

KEYS = ["series_uuid", "pred_id", "gt_id"]
_NONE = "array<struct<dimension:string,severity:string,reasoning:string>>"


def sides(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return findings.where("side = 'pred'"), findings.where("side = 'gt'")


def linked_pairs(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Each link with its two findings, its component, the sides of its group, whether its size is given elsewhere and whether a
    judge is needed for its texts."""
    pred, gt = sides(findings)
    pairs = links.pair_findings(links.match_components(matches), pred, gt)
    # told before rows are sorted into groups, so that texts nobody reads afterwards are not sorted with them
    pairs = pairs.withColumn("needs_judge", N.needs_judge("p_clinical_status", "g_clinical_status", "p_text", "g_text"))
    return links.group_sides(links.size_given_elsewhere(pairs))


def with_structured_errors(pairs: DataFrame) -> DataFrame:
    """``linked_pairs`` with the errors that rules find, and whether a judge is needed for the others."""
    c = F.col
    side = C.laterality_severity(c("p_laterality"), c("g_laterality"), c("p_group"), c("g_group"), c("p_clinical_significance"), c("g_clinical_significance"))
    measured = C.measurement_errors(c("p_measurements"), c("g_measurements"), c("size_elsewhere"))
    errors = C.structured_errors(c("p_clinical_status"), c("g_clinical_status"), side, c("p_laterality"), c("g_laterality"), c("p_comparison"), c("g_comparison"), measured)
    out = pairs.withColumn("structured_errors", errors)
    return out if "needs_judge" in out.columns else out.withColumn("needs_judge", N.needs_judge("p_clinical_status", "g_clinical_status", "p_text", "g_text"))


def records(rows: DataFrame) -> DataFrame:
    """One record per pair with ``structured_errors`` and the judge's ``errors``: both error lists and the category."""
    rows = rows.withColumn("text_errors", K.without_double_verdicts(F.col("errors"), F.col("structured_errors")))
    found = K.category(F.col("structured_errors"), F.col("text_errors"))
    return rows.select(
        *KEYS, found.alias("muc_category"), K.inc_triggered(F.col("structured_errors")).alias("inc_triggered"),
        K.effective(found, F.col("structured_errors"), F.col("text_errors"), F.col("g_clinical_significance")).alias("category"),
        F.col("g_clinical_significance").alias("gt_sig"), F.col("p_clinical_significance").alias("pred_sig"), "structured_errors", "text_errors",
        N.subsets("g_clinical_status", "g_comparison", "g_measurements").alias("gt_subsets"),
    )


def orphans(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Findings of both sides without a link, with their subsets."""
    pred, gt = sides(findings.withColumn("subsets", N.subsets()))
    return links.orphans(gt, matches, "gt").unionByName(links.orphans(pred, matches, "pred"))


def score(findings: DataFrame, matches: DataFrame, ask: Callable[[DataFrame, int], DataFrame] | None = None, indications: DataFrame | None = None, system: str = "", retries: int = judge.MOST_RETRIES, chunk: int = judge.CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(records, failures)`` of all links.

    ``ask(requests, attempt)`` answers the judge's requests as in ``judge.judge_with_splits``; without it no pair has text
    errors.  A pair without a valid answer fails its series, which then has no records: it must not pass for one without
    errors.  Requests go in the order of ``match_idx``, where ``matches`` has it, else of the candidate's position.
    """
    pairs = stored_by_series(with_structured_errors(linked_pairs(findings, matches)), "pairs")
    if ask is None:
        nothing = pairs.select("series_uuid", "pred_id", "gt_id", F.lit("").alias("reason")).where("false")
        return stored_by_series(records(pairs.withColumn("errors", F.array().cast(_NONE))), "records"), nothing
    # compared in order of its fields
    placed = pairs if "match_idx" in matches.columns else pairs.withColumn("match_idx", F.struct("p_pos", "pred_id", "gt_id"))
    chunks = judge.attribute_chunks(links.group_context(placed, *sides(findings)), chunk)
    answers, failures = judge.judge_with_splits(chunks.select("series_uuid", "chunk", "pair_id", "pred_id", "gt_id", "p_text", "g_text", "same_group_pred", "same_group_gt"), ask, retries, system, indications)
    failures = stored(failures, "failures")
    good = pairs.join(failures.select("series_uuid").distinct(), "series_uuid", "left_anti")
    return stored_by_series(records(judge.scatter(good, answers)), "records"), failures


class Audit(NamedTuple):
    """Tables of a whole audit."""

    records: DataFrame
    failures: DataFrame
    orphans: DataFrame
    outcomes: DataFrame
    tiers: DataFrame
    subsets: DataFrame
    attributes: DataFrame


def audit(findings: DataFrame, matches: DataFrame, **judging) -> Audit:
    """Scores all links and sums up: outcome counts, metrics by tier and by subset, and errors by dimension.

    Series that failed in scoring are in none of the counts.
    """
    scored, failures = score(findings, matches, **judging)
    rest = orphans(findings, matches).join(failures.select("series_uuid").distinct(), "series_uuid", "left_anti")
    rest = stored_by_series(rest, "orphans")
    by_subset = metrics.by_subset(scored, rest)
    subsets = metrics.tier_metrics(*by_subset, ["subset"]).join(metrics.muc_counts(*by_subset, ["subset"]), "subset")
    return Audit(scored, failures, rest, metrics.muc_counts(scored, rest), metrics.tier_metrics(scored, rest), subsets, metrics.attribute_breakdown(scored))
