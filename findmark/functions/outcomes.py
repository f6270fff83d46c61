"""Column builders that turn a pair's errors into its outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_double_verdicts(text: Column, structured: Column, dimensions: tuple[str, ...] = ("measurement", "comparison")) -> Column:
    """Text errors, without those on a dimension that has a structured error; a major one stays if no structured one is."""

    def stays(e: Column) -> Column:
        same = lambda s: s["dimension"] == e["dimension"]
        stronger = (e["severity"] == "major") & ~F.exists(structured, lambda s: same(s) & (s["severity"] == "major"))
        return ~e["dimension"].isin(*dimensions) | ~F.exists(structured, same) | stronger

    return F.filter(text, stays)


def inc_triggered(structured: Column) -> Column:
    return F.exists(structured, lambda e: (e["dimension"] == "clinical_status") & e["triggers_inc"])


def category(structured: Column, text: Column) -> Column:
    return F.when(inc_triggered(structured), "INC").when((F.size(structured) > 0) | (F.size(text) > 0), "PAR").otherwise("COR")


def effective(found: Column, structured: Column, text: Column, gt_significance: Column | None) -> Column:
    """``PAR`` becomes ``INC`` with a major error, or with a certainty error on a critical reference finding."""
    major = lambda a: F.exists(a, lambda e: e["severity"] == "major")
    worse = major(structured) | major(text)
    if gt_significance is not None:
        worse = worse | (gt_significance.eqNullSafe("critical") & (F.exists(text, lambda e: e["dimension"] == "certainty") | F.exists(structured, lambda e: e["dimension"] == "certainty")))
    return F.when((found == "PAR") & worse, "INC").otherwise(found)
