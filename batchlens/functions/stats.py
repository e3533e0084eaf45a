"""Statistics of groups with the conventions of the checks."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def pearson(y: Column, x: Column, by: WindowSpec | None = None) -> Column:
    """Pearson's r, of a group or over a window; 0.0 where either side is constant."""
    sxx, syy, sxy = (f(y, x) if by is None else f(y, x).over(by) for f in (F.regr_sxx, F.regr_syy, F.regr_sxy))
    return F.when((sxx <= 0) | (syy <= 0), F.lit(0.0)).otherwise(sxy / F.sqrt(sxx * syy))


def count_if(condition: Column) -> Column:
    """How many rows meet the condition; null doesn't."""
    return F.count(F.when(condition, F.lit(1)))


def any_of(condition: Column) -> Column:
    """Whether some row meets the condition."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def first_by(value: Column, high: Column, tie: Column) -> Column:
    """``value`` where ``high`` is largest; the smallest ``tie`` among equals."""
    return F.max_by(value, F.struct(high, -tie))
