"""Column builders that compare the structured fields of a linked pair; all run as Spark expressions.

``p`` is the candidate's value and ``g`` the reference's.  Errors are structs of ``schema.ERROR``; null stands for none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findmark import schema
from findmark.functions.normalize import lookup

#: Assignments up to which the first of the best index tuples is found; longer lists are aligned in sorted order.
MOST_ASSIGNMENTS = 40_320


def error(dimension: str, severity: Column | str, p: Column, g: Column, reasoning: Column | str, inc: bool = False) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    reasoning = F.lit(reasoning) if isinstance(reasoning, str) else reasoning
    return F.struct(
        F.lit(dimension).alias("dimension"), severity.alias("severity"), p.cast("string").alias("pred_value"), g.cast("string").alias("gt_value"),
        reasoning.alias("reasoning"), F.lit(inc).alias("triggers_inc"),
    )


def status_conflict(p: Column, g: Column) -> Column:
    return F.when(~p.eqNullSafe(g), error("clinical_status", "major", p, g, "statuses differ", True))


def laterality_severity(p: Column, g: Column, p_group: Column, g_group: Column, p_sig: Column, g_sig: Column) -> Column:
    """Severity of a side difference that the match groups do not resolve; null if there is none."""
    resolved = p.eqNullSafe(g) | g.isNull() | p_group.eqNullSafe(g_group) | (p_group.isNull() & g_group.eqNullSafe("bilateral"))
    return F.when(~resolved, F.when(p_sig.eqNullSafe("routine") & g_sig.eqNullSafe("routine"), "minor").otherwise("major"))


def comparison_severity(p: Column, g: Column) -> Column:
    active = lambda c: c.isin(*schema.ACTIVE)
    return F.when(p.eqNullSafe(g), None).when(p.isNull() | g.isNull(), "minor").when(active(p) != active(g), "major").otherwise("minor")


def canonical(m: Column) -> Column:
    """A measurement's value in its base unit; an unknown or missing unit leaves it."""
    return m["value"] * F.coalesce(lookup(schema.UNIT_FACTORS, F.lower(m["unit"])), F.lit(1.0))


def exceeds(p: Column, g: Column, share: float) -> Column:
    """Whether the relative difference is over ``share``; a reference of zero is exceeded by anything else."""
    return F.when(g == 0, p != 0).otherwise(F.abs(p - g) / F.abs(F.nullif(g, F.lit(0.0))) > share)


def unit_kind(m: Column) -> Column:
    """Length, volume, or an unknown unit by itself; null for no unit."""
    return F.when(m["unit"].isNotNull(), F.coalesce(lookup(schema.UNIT_KINDS, F.lower(m["unit"])), F.lower(m["unit"])))


def size_severity(p: Column, g: Column) -> Column:
    kinds = unit_kind(p).isNotNull() & unit_kind(g).isNotNull() & (unit_kind(p) != unit_kind(g))
    far = exceeds(canonical(p), canonical(g), schema.SIZE_SHARE) & (F.abs(canonical(p) - canonical(g)) >= schema.SIZE_FLOOR)
    return F.when(kinds | far, "minor")


def ratio_severity(p: Column, g: Column) -> Column:
    return F.when(exceeds(canonical(p), canonical(g), schema.RATIO_SHARE), "major")


def count_severity(p: Column, g: Column) -> Column:
    return F.when(p["value"] != g["value"], "major")


def attenuation_severity(p: Column, g: Column) -> Column:
    a, b = canonical(p), canonical(g)
    crossed = F.exists(F.array(*map(F.lit, schema.ATTENUATION_CLIFFS)), lambda c: (a <= c) != (b <= c))
    return F.when(crossed | (F.abs(a - b) > schema.ATTENUATION_STEP), "major")


def other_severity(p: Column, g: Column) -> Column:
    return F.when(p["value"] != g["value"], "minor")


#: Comparator by category; callers may pass a dict of their own.
COMPARATORS = {"size": size_severity, "ratio": ratio_severity, "count": count_severity, "attenuation": attenuation_severity, "other": other_severity}


def align_categories(p: Column, g: Column) -> Column:
    """Candidate measurements, each with the category of the first reference one of the same raw value and unit."""

    def own(m: Column) -> Column:
        same = F.filter(g, lambda x: x["value"].eqNullSafe(m["value"]) & x["unit"].eqNullSafe(m["unit"]))
        return F.struct(m["value"].alias("value"), m["unit"].alias("unit"), F.coalesce(F.try_element_at(same, F.lit(1))["category"], m["category"]).alias("category"))

    return F.transform(p, own)


def assignment(short: Column, long: Column) -> Column:
    """``struct<cost, idx>``: where each value of ``short`` goes in ``long`` (as long or longer) at the least total distance;
    ties by the first index tuple.

    A programme over the subsets of ``long``: value after value, the best tuple of each set of places that are taken goes on,
    so there are never more states than subsets, whatever the number of assignments.
    """
    start = F.array(F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("idx")))
    places = F.sequence(F.lit(0), F.size(long) - 1)

    def grow(states: Column, value: Column) -> Column:
        bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
        free = lambda st: F.filter(places, lambda j: st["taken"].bitwiseAND(bit(j)) == 0)
        step = lambda st: F.transform(free(st), lambda j: F.struct(st["taken"].bitwiseOR(bit(j)).alias("taken"), (st["cost"] + F.abs(value - F.element_at(long, j + 1))).alias("cost"), F.concat(st["idx"], F.array(j)).alias("idx")))
        # in order of the taken places, then of cost and tuple: the first of each set stays
        new = F.array_sort(F.flatten(F.transform(states, step)))
        return _with(new, lambda all_: F.filter(all_, lambda st, i: (i == 0) | (st["taken"] != F.get(all_, i - 1)["taken"])))

    last = F.aggregate(short, start, grow)
    return F.array_min(F.transform(last, lambda st: F.struct(st["cost"].alias("cost"), st["idx"].alias("idx"))))


def sorted_assignment(short: Column, long: Column) -> Column:
    """The same cost by a programme over both lists in sorted order: in one dimension a best assignment never crosses."""
    order = lambda a: F.array_sort(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    s, t = order(short), order(long)
    none = F.struct(F.lit(float("inf")).alias("cost"), F.array().cast("array<struct<s:int,i:int>>").alias("at"))
    first = F.transform(F.sequence(F.lit(0), F.size(long)), lambda _: F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<struct<s:int,i:int>>").alias("at")))

    def row(before: Column, x: Column) -> Column:
        def cell(cells: Column, j: Column) -> Column:
            y, left, up = F.element_at(t, j), F.element_at(cells, -1), F.element_at(before, j)
            take = F.struct((up["cost"] + F.abs(x["v"] - y["v"])).alias("cost"), F.concat(up["at"], F.array(F.struct(x["i"].alias("s"), y["i"].alias("i")))).alias("at"))
            return F.concat(cells, F.array(F.when(left["cost"] <= take["cost"], left).otherwise(take)))

        return F.aggregate(F.sequence(F.lit(1), F.size(long)), F.array(none), cell)

    last = F.element_at(F.aggregate(s, first, row), -1)
    return F.struct(last["cost"].alias("cost"), F.transform(F.array_sort(last["at"]), lambda a: a["i"]).alias("idx"))


def best_assignment(short: Column, long: Column) -> Column:
    """With the first of the best tuples, or in sorted order where there are more than ``MOST_ASSIGNMENTS``."""
    n, k = F.size(long), F.size(short)
    ways = F.aggregate(F.when(k > 0, F.sequence(n - k + 1, n)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, x: F.least(a * x, F.lit(1e12)))
    return F.when(k == 0, F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("idx"))).when(ways <= MOST_ASSIGNMENTS, assignment(short, long)).otherwise(sorted_assignment(short, long))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paired(p: Column, g: Column) -> Column:
    """Measurements of one category side by side: ``pairs`` of (p, g), and reference ones that are left, ``extra``."""
    values = lambda a: F.transform(a, canonical)
    p_short = F.size(p) <= F.size(g)
    best = best_assignment(F.when(p_short, values(p)).otherwise(values(g)), F.when(p_short, values(g)).otherwise(values(p)))

    def sides(b: Column) -> Column:
        at = lambda a, i: F.element_at(a, i + 1)
        pairs = F.transform(b["idx"], lambda j, i: F.when(p_short, F.struct(at(p, i).alias("p"), at(g, j).alias("g"))).otherwise(F.struct(F.try_element_at(p, j + 1).alias("p"), F.try_element_at(g, i + 1).alias("g"))))
        left = F.when(p_short, F.filter(g, lambda _, i: ~F.array_contains(b["idx"], i))).otherwise(F.filter(g, lambda _: F.lit(False)))
        return F.struct(pairs.alias("pairs"), left.alias("extra"))

    one = F.struct(F.array(F.struct(F.element_at(p, 1).alias("p"), F.element_at(g, 1).alias("g"))).alias("pairs"), F.slice(g, 1, 0).alias("extra"))
    return F.when((F.size(p) == 1) & (F.size(g) == 1), one).otherwise(_with(best, sides))


def measurement_errors(p: Column, g: Column, size_elsewhere: Column, comparators: dict | None = None) -> Column:
    """Errors of the measurements; a null list is an empty one."""
    comparators = COMPARATORS if comparators is None else comparators
    none = F.array().cast(f"array<{schema.MEASUREMENT}>")
    p, g = F.coalesce(p, none), F.coalesce(g, none)
    no_error = F.array().cast(f"array<{schema.ERROR}>")
    omitted = lambda m, why: error("measurement", "minor", F.lit(None).cast("string"), F.to_json(m), why)

    def of_category(p: Column, c: Column) -> Column:
        """The errors of one category; the expression is the same for all of them."""
        own = lambda a: F.filter(a, lambda m: m["category"] == c)
        lacking_why = F.concat(c, F.lit(" is left out"))

        def both(t: Column) -> Column:
            def graded(s: Column) -> Column:
                def severity(x: Column) -> Column:
                    out = F.lit(None).cast("string")
                    for name, compare in comparators.items():
                        out = F.when(c == name, compare(x["p"], x["g"])).otherwise(out)
                    return out

                rated = F.transform(s["pairs"], lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g"), severity(x).alias("severity")))
                return F.concat(
                    F.transform(F.filter(rated, lambda x: x["severity"].isNotNull()), lambda x: error("measurement", x["severity"], F.to_json(x["p"]), F.to_json(x["g"]), F.concat(c, F.lit(" differs")))),
                    F.transform(s["extra"], lambda m: omitted(m, F.concat(F.lit("one more "), lacking_why))),
                )

            lacking = F.when(size_elsewhere & (c == "size"), no_error).otherwise(F.transform(t["g"], lambda m: omitted(m, lacking_why)))
            return F.when(F.size(t["g"]) == 0, no_error).when(F.size(t["p"]) == 0, lacking).otherwise(_with(paired(t["p"], t["g"]), graded))

        return _with(F.struct(own(p).alias("p"), own(g).alias("g")), both)

    # only categories that the reference has can have errors
    categories = F.filter(F.array(*map(F.lit, schema.CATEGORY)), lambda c: F.exists(g, lambda m: m["category"] == c))
    whole = _with(align_categories(p, g), lambda a: F.flatten(F.transform(categories, lambda c: of_category(a, c))))
    return F.when(F.size(g) == 0, no_error).otherwise(whole)


def structured_errors(p_status: Column, g_status: Column, laterality: Column, p_side: Column, g_side: Column, p_comparison: Column, g_comparison: Column, measured: Column) -> Column:
    """All structured errors of a pair: a status conflict stands alone, a pair of normal findings has none."""
    side = F.when(laterality.isNotNull(), error("laterality", laterality, p_side, g_side, "sides differ"))
    change = comparison_severity(p_comparison, g_comparison)
    change = F.when(change.isNotNull(), error("comparison", change, p_comparison, g_comparison, "changes differ"))
    rest = F.concat(F.array_compact(F.array(side, change)), measured)
    return F.when(~p_status.eqNullSafe(g_status), F.array(status_conflict(p_status, g_status))).when(p_status == "normal", F.array().cast(f"array<{schema.ERROR}>")).otherwise(rest)
