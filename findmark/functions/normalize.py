"""Column builders that normalise findings and classify single rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from findmark import schema


def one_of(c: Column | str, values: tuple[str, ...], default: str | None) -> Column:
    """``c`` where it is one of ``values``, else the default; spelling has to be exact."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*values), c).otherwise(F.lit(default))


def status(c: Column | str) -> Column:
    return one_of(c, schema.STATUS, "abnormal")


def significance(c: Column | str) -> Column:
    return one_of(c, schema.SIGNIFICANCE, "routine")


def comparison(c: Column | str) -> Column:
    return one_of(c, schema.COMPARISON, None)


def laterality(c: Column | str) -> Column:
    """Trimmed and lower-cased before the look-up, unlike the other fields."""
    return one_of(F.lower(F.trim(c)), schema.LATERALITY, None)


def lookup(table: dict[str, object], key: Column) -> Column:
    """The value of a small fixed table, null where it lacks the key."""
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def unit(c: Column | str) -> Column:
    """Exact aliases to their short form; others stay, lower-cased; empty is null."""
    low = F.lower(F.trim(c))
    return F.nullif(F.coalesce(lookup(schema.UNIT_ALIASES, low), low), F.lit(""))


def measurements(items: Column | str) -> Column:
    """``array<variant>`` to measurements: objects with a numeric value (or a number's text) and a category; others go."""

    def read(v: Column) -> Column:
        category = F.try_variant_get(v, "$.category", "string")
        return F.struct(
            F.try_variant_get(v, "$.value", "string").try_cast("double").alias("value"),
            unit(F.try_variant_get(v, "$.unit", "string")).alias("unit"),
            F.when(category.isNotNull(), one_of(category, schema.CATEGORY, "other")).alias("category"),
        )

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<variant>")), read), lambda m: m["value"].isNotNull() & m["category"].isNotNull())


def finding_id(series: Column | str, pos: Column | str) -> Column:
    """``<series>_001`` and on; ``pos`` is the raw slot from zero."""
    return F.format_string("%s_%03d", F.col(series) if isinstance(series, str) else series, (F.col(pos) if isinstance(pos, str) else pos) + 1)


def collapsed(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def needs_judge(p_status: str, g_status: str, p_text: str, g_text: str) -> Column:
    """Whether free text has to be judged: never across statuses; normal pairs if hedged, abnormal ones if worded differently."""
    hedged = lambda c: F.coalesce(F.col(c).rlike(f"(?i){schema.HEDGES}"), F.lit(False))
    return F.when(~F.col(p_status).eqNullSafe(F.col(g_status)), False).when(F.col(p_status) == "normal", hedged(p_text) | hedged(g_text)).otherwise(~collapsed(p_text).eqNullSafe(collapsed(g_text)))


def is_unsupported(c: str = "clinical_status") -> Column:
    return ~F.col(c).eqNullSafe("normal")


def is_missed(c: str = "clinical_status", s: str = "clinical_significance") -> Column:
    return ~F.col(c).eqNullSafe("normal") | ~F.col(s).eqNullSafe("routine")


def subsets(status_col: str = "clinical_status", comparison_col: str = "comparison", measured: str = "measurements") -> Column:
    """The overlapping subsets of a finding."""
    has_m, has_c = F.coalesce(F.size(measured) > 0, F.lit(False)), F.col(comparison_col).isNotNull()
    regular = F.when(~has_m & ~has_c, F.when(F.col(status_col).eqNullSafe("normal"), "normal-regular").otherwise("abnormal-regular"))
    return F.array_compact(F.array(F.when(has_m, "measurement"), F.when(has_c, "comparison"), regular))


def tiers() -> Column:
    """The four tiers with their pools, to be exploded."""
    return F.array(*(F.struct(F.lit(t).alias("tier"), F.array(*map(F.lit, pool)).alias("pool")) for t, pool in schema.TIERS.items()))


def judge_errors(errors: Column | str) -> Column:
    """Errors of the accepted dimensions and severities, with a reasoning."""
    ok = F.filter(errors, lambda e: e["dimension"].isin(*schema.JUDGED) & e["severity"].isin(*schema.SEVERITY))
    return F.transform(ok, lambda e: F.struct(e["dimension"].alias("dimension"), e["severity"].alias("severity"), F.coalesce(e["reasoning"], F.lit("")).alias("reasoning")))
