"""What the labels of analytes say, as column expressions.

Labels are read from the front: a run of characters of one class is taken off, and the rest is looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols of the elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La "
    "Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po "
    "At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg "
    "Cn Nh Fl Mc Lv Ts Og"
).split()
#: The resolutions of a sector-field instrument.
RESOLUTIONS = ("LR", "MR", "HR")
_DIGITS = "0123456789"


def _flat(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))


def _after(text: Column, front: Column) -> Column:
    return F.ltrim(F.substring(text, F.length(front) + 1, F.lit(1 << 20)))


def _digits(text: Column) -> Column:
    """The digits that ``text`` begins with."""
    return F.left(text, F.length(text) - F.length(F.ltrim(text, F.lit(_DIGITS))))


def _symbol(text: Column) -> Column:
    """The capital, and the small letters after it, that ``text`` begins with."""
    return F.regexp_extract(text, "^[A-Z][a-z]*", 0)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def mass_label(label: Column) -> Column:
    """mass, mass_shift, element and mode of labels such as ``31 -> 47 P [O2]``; all null where the symbol isn't an element's."""
    flat = _flat(label)
    mass = _digits(flat)
    rest = _after(flat, mass)
    moved = rest.startswith("->")
    target = F.when(moved, _after(rest, F.lit("->"))).otherwise(F.lit(""))
    shift = _digits(target)
    rest = F.ltrim(F.when(moved, _after(target, shift)).otherwise(rest), F.lit("[ "))
    symbol = _symbol(rest)
    rest = F.ltrim(_after(rest, symbol), F.lit("] "))
    mode = F.when(rest.startswith("[") & rest.contains("]"), F.trim(F.substring_index(F.substring(rest, 2, 1 << 20), "]", 1)))
    real = (mass != "") & symbol.isin(*ELEMENTS) & (~moved | (shift != ""))
    own = lambda c: F.when(real, c)
    return F.struct(own(mass.try_cast("int")).alias("mass"), own(shift.try_cast("int")).alias("mass_shift"), own(symbol).alias("element"), own(_some(mode)).alias("mode"))


def isotope_label(label: Column) -> Column:
    """mass, element and resolution of labels such as ``Na23(LR)``."""
    flat = _flat(label)
    symbol = _symbol(flat)
    rest = F.substring(flat, F.length(symbol) + 1, F.lit(1 << 20))
    mass = _digits(rest)
    mode = F.translate(_after(rest, mass), " ", "")
    good = (symbol != "") & (F.length(symbol) <= 2) & (mass != "") & mode.isin(*(f"({x})" for x in RESOLUTIONS))
    return F.struct(F.when(good, mass.try_cast("int")).alias("mass"), F.when(good, symbol).alias("element"), F.when(good, F.btrim(mode, F.lit("()"))).alias("mode"))


def line_label(label: Column) -> Column:
    """label, element, wavelength and unit of emission lines such as ``U 385.958 (mg/L)``; cps is no unit.

    A wavelength has two or three digits and one to four decimals; more decimals are left out, with what follows.
    """
    flat = _flat(label)
    symbol = _symbol(flat)
    rest = F.substring(flat, F.length(symbol) + 1, F.lit(1 << 20))
    whole = _digits(F.ltrim(rest))
    point = _after(F.ltrim(rest), whole)
    decimals = _digits(F.substring(point, 2, 1 << 20))
    tail = F.ltrim(F.substring(point, F.length(decimals) + 2, F.lit(1 << 20)))
    good = F.length(symbol).isin(1, 2) & rest.startswith(" ") & F.length(whole).isin(2, 3) & point.startswith(".") & (decimals != "")
    nm = F.concat(whole, F.lit("."), F.left(decimals, F.lit(4)))
    unit = F.when(good & (F.length(decimals) <= 4) & tail.startswith("(") & tail.contains(")"), _some(F.trim(F.substring_index(F.substring(tail, 2, 1 << 20), ")", 1))))
    return F.struct(
        F.when(good, F.concat_ws(" ", symbol, nm)).alias("label"), F.when(good, symbol).alias("element"), F.when(good, nm.try_cast("double")).alias("wavelength_nm"),
        F.when(F.lower(unit) != "cps", unit).alias("unit"),
    )
