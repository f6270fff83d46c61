"""Rule judges: Column builders that read findings and grade differences from words alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of sections that a report may have.
HEADERS = ("INDICATION", "CLINICAL HISTORY", "CLINICAL INFORMATION", "HISTORY", "REASON FOR EXAM", "REASON FOR EXAMINATION", "COMMENT", "CLINICAL DETAILS", "CLINICAL CONTEXT")
SECTIONS = ("FINDINGS", "IMPRESSION", "TECHNIQUE", "COMPARISON", "CONCLUSION", "EXAMINATION", "PROCEDURE", "RECOMMENDATION")
_NORMAL = r"(?i)\b(no|not|without|unremarkable|normal|patent|negative for|resolved)\b"
_HEDGED = r"(?i)\b(possibl|probabl|may represent|suspicious|cannot be excluded)"


def indication(text: Column | str) -> Column:
    """The text after a known header up to the next section, white space joined; empty without one."""
    text = F.col(text) if isinstance(text, str) else text
    heads, stops = "|".join(sorted(HEADERS, key=len, reverse=True)), "|".join((*SECTIONS, *HEADERS))
    found = F.regexp_extract(text, rf"(?is)(?:^|\n)\s*(?:{heads})\s*:\s*(.*?)\s*(?=\n\s*(?:{stops})\s*:|$)", 1)
    return F.coalesce(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def sentences(text: Column | str) -> Column:
    """Sentences of all sections but the indication's; section names go."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(text, rf"(?im)^\s*(?:{'|'.join(SECTIONS)})\s*:", "")
    parts = F.transform(F.split(plain, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def status(text: Column | str) -> Column:
    """Normal by negation or normal wording, unless hedged; abnormal when unsure."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(_NORMAL) & ~text.rlike(_HEDGED), "normal").otherwise("abnormal")


def side(text: Column | str) -> Column:
    text = F.lower(text)
    both, left, right = text.rlike(r"\b(bilateral|both|bibasilar)\b"), text.rlike(r"\b(left|lingula|retrocardiac)\b"), text.rlike(r"\b(right|minor fissure)\b")
    return F.when(both | (left & right), "bilateral").when(left, "left").when(right, "right")


def change(text: Column | str) -> Column:
    """New before worsening, improving and stable; resolved only when nothing else is said."""
    text = F.lower(text)
    word = lambda w: text.rlike(rf"\b({w})\b")
    return (
        F.when(word("new|newly identified|not seen on prior"), "new")
        .when(word("increased|larger|worse|worsening|enlarged|progressive"), "worsening")
        .when(word("decreased|smaller|improved|improving|resolving|better"), "improving")
        .when(word("unchanged|similar to prior|no change|stable"), "stable")
        .when(word("no longer present|cleared|resolution of|resolved"), "resolved")
    )


_N, _U = r"\d+(?:\.\d+)?", r"(?:mm|cm|ml|hounsfield units|hu|%)(?![a-z0-9])"
#: Words that begin a value of an earlier study, that make a length a distance, and things that are counted.
_EARLIER = "previously|formerly"
_APART = "above|below|from|proximal|distal|superior|inferior|anterior|posterior"
_COUNTED = "nodes|nodules|cysts|lesions|masses|stones|calculi|fractures|aneurysms|metastases|foci|polyps|opacities|effusions"
_SCORES = "suv(?: ?max)?|agatston score"
#: Mentions of numbers: earlier ones, changes, products and ranges with a unit, scores, and counted things.
_MENTION = (
    rf"(?:{_EARLIER})[a-z ]{{0,12}}{_N}(?:\s*(?:{_U})?\s*(?:x|by|-|to)\s*{_N})*\s*{_U}"
    rf"|from {_N}\s*(?:{_U})?\s*to {_N}\s*{_U}"
    rf"|(?<![a-z0-9.]){_N}\s*(?:(?:{_U})?\s*(?:x|by|-|to)\s*{_N}\s*)*{_U}(?:\s+(?:{_APART})\b)?"
    rf"|(?:{_SCORES})(?: of)?\s+{_N}"
    rf"|(?<![a-z0-9.]){_N} (?:[a-z]+ ){{0,2}}(?:{_COUNTED})\b"
)


def numbers(text: Column | str) -> Column:
    """Current numbers as measurements, in order.

    Lengths and volumes are sizes, each number of a product or a range for itself; a length that tells where something lies is
    of category other, and so are scores.  Of a change from one value to another the second counts, values of an earlier study
    do not.  Hounsfield units are attenuations, percentages ratios, and a number before a thing that is counted is a count.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(_MENTION), F.lit(0))

    def read(m: Column) -> Column:
        name = F.regexp_extract(m, rf"({_U})[a-z ]*$", 1)
        unit = F.when(name == "%", "pct").when(name == "hounsfield units", "hu").when(name != "", name)
        apart = m.rlike(rf"^({_SCORES})") | m.rlike(rf"({_APART})$")
        category = F.when(apart, "other").when(unit == "pct", "ratio").when(unit == "hu", "attenuation").when(unit.isNull(), "count").otherwise("size")
        values = F.regexp_extract_all(m, F.lit(_N), F.lit(0))
        values = F.when(m.rlike(rf"^({_EARLIER})"), F.slice(values, 1, 0)).when(m.startswith("from "), F.slice(values, -1, 1)).otherwise(values)
        return F.transform(values, lambda v: F.struct(v.cast("double").alias("value"), unit.alias("unit"), category.alias("category")))

    return F.flatten(F.transform(found, read))


def certainty_rank(text: Column | str) -> Column:
    """Steps from present (0) to absent (5)."""
    text = F.lower(text)
    word = lambda w: text.rlike(rf"\b({w})")
    return (
        F.when(word("unlikely|no definite|no convincing"), 4)
        .when(word("less likely"), 3)
        .when(word("no |no evidence of|without "), 5)
        .when(word("possibl|may represent|cannot be excluded|versus artifact"), 2)
        .when(word("suspicious for|probabl|likely"), 1)
        .otherwise(0)
    )


def certainty_severity(p: Column | str, g: Column | str) -> Column:
    away = F.abs(certainty_rank(p) - certainty_rank(g))
    return F.when(away >= 2, "major").when(away == 1, "minor")


#: Words of magnitude by step.
GRADES = ((1, "minimal|trace|tiny|slight|mild|mildly|small"), (2, "moderate|moderately"), (3, "marked|markedly|severe|severely|massive|large|critical"))


def grade_rank(text: Column | str) -> Column:
    text = F.lower(text)
    return F.coalesce(*(F.when(text.rlike(rf"\b({words})\b"), rank) for rank, words in reversed(GRADES)))


def grade_severity(p: Column | str, g: Column | str) -> Column:
    """Two steps apart major, one minor; left out: major if high, else minor; only the candidate's: none."""
    a, b = grade_rank(p), grade_rank(g)
    return F.when(b.isNull(), None).when(a.isNull(), F.when(b == 3, "major").otherwise("minor")).when(F.abs(a - b) >= 2, "major").when(F.abs(a - b) == 1, "minor")


def tokens(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: F.length(t) > 1))


def likeness(p: Column | str, g: Column | str) -> Column:
    """Jaccard likeness of two token arrays; zero if both are empty."""
    return F.coalesce(F.size(F.array_intersect(p, g)) / F.nullif(F.size(F.array_union(p, g)), F.lit(0)), F.lit(0.0))
