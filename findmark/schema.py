"""Values, tiers and table schemas of the audit.

Fixed values: enumerations, the list of dimensions, unit spellings and factors, thresholds and the pattern of hedges have to
be these for results to be right.
"""

from __future__ import annotations

STATUS = ("normal", "abnormal")
SIGNIFICANCE = ("critical", "urgent", "notable", "routine")
LATERALITY = ("left", "right", "bilateral")
COMPARISON = ("stable", "improving", "worsening", "new", "resolved")
CATEGORY = ("size", "count", "attenuation", "ratio", "other")
DIMENSIONS = ("clinical_status", "location", "laterality", "extent", "grade", "appearance", "diagnosis", "certainty", "comparison", "measurement")
JUDGED = ("location", "extent", "grade", "appearance", "diagnosis", "certainty", "comparison", "measurement")
SEVERITY = ("major", "minor")
OUTCOMES = ("COR", "PAR", "INC", "MIS", "SPU")
SUBSETS = ("measurement", "comparison", "abnormal-regular", "normal-regular")
#: Nested pools of significance.
TIERS = {"all": SIGNIFICANCE, "significant": SIGNIFICANCE[:3], "triage": SIGNIFICANCE[:2], "critical": SIGNIFICANCE[:1]}
ACTIVE = ("worsening", "new")

UNIT_ALIASES = {
    "%": "pct", "millimeter": "mm", "millimeters": "mm", "millimetre": "mm", "millimetres": "mm",
    "centimeter": "cm", "centimeters": "cm", "centimetre": "cm", "centimetres": "cm",
    "milliliter": "ml", "milliliters": "ml", "millilitre": "ml", "millilitres": "ml", "cc": "ml", "cm3": "ml", "cm^3": "ml", "cm³": "ml",
}
#: Factors other than one, to millimetres and millilitres.
UNIT_FACTORS = {"cm": 10.0, "inch": 25.4, "in": 25.4, "inches": 25.4, "l": 1000.0}
UNIT_KINDS = {"mm": "length", "cm": "length", "inch": "length", "in": "length", "inches": "length", "ml": "volume", "l": "volume"}
SIZE_SHARE, SIZE_FLOOR, RATIO_SHARE, ATTENUATION_STEP, ATTENUATION_CLIFFS = 0.2, 2.0, 0.3, 20.0, (-10.0, 10.0, 20.0)
HEDGES = r"\b(possibl|probabl|may|might|cannot|can't|not (be )?(excluded|ruled out)|questionabl|equivocal|indeterminate|suspicious|likely|unlikely|no (definite|definitive|convincing))"

MEASUREMENT = "struct<value:double,unit:string,category:string>"
ERROR = "struct<dimension:string,severity:string,pred_value:string,gt_value:string,reasoning:string,triggers_inc:boolean>"
FINDING = f"series_uuid string, side string, pos int, finding_id string, text string, clinical_status string, clinical_significance string, laterality string, comparison string, measurements array<{MEASUREMENT}>"
