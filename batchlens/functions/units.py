"""Units of concentration and numbers as exports write them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mass concentration units, as multiples of 1 ppb.
UNIT_FACTORS = {
    "ppb": 1.0, "ug/l": 1.0, "ng/ml": 1.0, "ug/kg": 1.0, "ng/g": 1.0,
    "ppm": 1e3, "mg/l": 1e3, "ug/ml": 1e3, "mg/kg": 1e3, "ug/g": 1e3,
    "ppt": 1e-3, "ng/l": 1e-3, "pg/ml": 1e-3, "pg/g": 1e-3,
    "%": 1e7,
}
#: Words for a result that was measured and not detected.
NON_DETECTS = ("nd", "n.d.", "n.d", "<dl", "<mdl", "<loq", "<lod")
#: Cells that hold no number.
NO_NUMBER = ("", "-", "N/A", "n/a", "NA")
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)$"
_BLANKS = r"^[\s ]+|[\s ]+$"


def stripped(text: Column) -> Column:
    """Without white space at either end, tabs and no-break spaces included."""
    return F.regexp_replace(text, _BLANKS, "")


def number(text: Column) -> Column:
    """A cell as a double, thousands commas dropped; null where it isn't a number."""
    clean = F.regexp_replace(stripped(text), ",", "")
    return F.when(clean.rlike(_NUMBER), clean.try_cast("double"))


def parsed_concentration(text: Column) -> Column:
    """A struct (conc, below_dl, dl): a number, a censored result with or without a limit, or nothing."""
    clean = stripped(F.coalesce(text, F.lit("")))
    listed = F.lower(clean).isin(*NON_DETECTS)
    below = listed | clean.startswith("<")
    limit = F.when(~listed & clean.startswith("<"), number(F.substring(clean, 2, 1 << 20)))
    return F.struct(F.when(~below, number(clean)).alias("conc"), below.alias("below_dl"), limit.alias("dl"))


def normal_unit(unit: Column) -> Column:
    """One spelling for the units that exports write in several."""
    bare = F.regexp_replace(stripped(F.coalesce(unit, F.lit(""))), r"^[\[\]() ]+|[\[\]() ]+$", "")
    return F.translate(F.lower(bare), "µμ ", "uu")


def converted(value: Column, source: Column, target: Column) -> Column:
    """``value`` in another unit: unchanged where the units are equal, null where either is unknown."""
    table = F.create_map(*[F.lit(x) for pair in UNIT_FACTORS.items() for x in pair])
    a, b = normal_unit(source), normal_unit(target)
    return F.when(source == target, value).when(a == b, value).otherwise(F.try_divide(value * F.try_element_at(table, a), F.try_element_at(table, b)))
