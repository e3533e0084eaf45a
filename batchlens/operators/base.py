"""What the checks share: their rows, when they can't be evaluated, and the expressions of a recovery and a blank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.model import BatchFrames, carries

KEY = ("batch_id", "row_pos")


@dataclass(frozen=True)
class Check:
    """The plans of one check.

    ``details`` has ``batch_id``, ``ok`` (true, false, or null for not decided) and the check's own columns;
    ``blocked`` has ``batch_id`` and ``reason`` for each batch that can't be evaluated; ``verdict``, where a check
    has its own rule, has ``batch_id``, ``outcome`` and ``reason``.
    """

    details: DataFrame
    blocked: DataFrame
    verdict: DataFrame | None = None
    undecided: str = "evaluated, but no decisive rows"


def loq(params: dict, label: Column) -> Column:
    """The limit of quantitation of an analyte: one number, or by label with a default of 0.1."""
    table = params.get("loq_ppb", 0.1)
    if not isinstance(table, dict):
        return F.lit(float(table))
    out = F.lit(float(table.get("default", 0.1)))
    for name, value in table.items():
        if name != "default":
            out = F.when(label == name, F.lit(float(value))).otherwise(out)
    return out


def blank_limit(params: dict, label: Column) -> Column:
    """The limit of a blank: a number, LOQ, or half of it."""
    limit = params.get("limit", "LOQ")
    if isinstance(limit, (int, float)) and not isinstance(limit, bool):
        return F.lit(float(limit))
    name = str(limit).upper().replace(" ", "")
    if name == "LOQ":
        return loq(params, label)
    if name in ("1/2LOQ", "0.5LOQ", "HALFLOQ"):
        return loq(params, label) * F.lit(0.5)
    raise ValueError(f"unknown blank limit: {limit!r}")


def window(params: dict, name: str = "window_pct", default: tuple[float, float] = (90, 110)) -> tuple[float, float]:
    lo, hi = params.get(name, default)
    return float(lo), float(hi)


def analytes(b: BatchFrames) -> DataFrame:
    return b.analytes.where("role = 'analyte'").select("batch_id", "pos", "label", "element")


def every_result(b: BatchFrames, samples: DataFrame) -> DataFrame:
    """A row for each of the samples and each analyte of its batch, with its result where there is one.

    Of samples that carry their results there are rows with a result only: the others decide nothing.
    """
    if carries(samples):
        own = [c for c in samples.columns if c not in ("results", "cps", "flagged")]
        return samples.select(*own, F.inline("results")).where("pos is not null").withColumn("below_dl", F.coalesce("below_dl", F.lit(False)))
    columns = b.results.select("batch_id", "row_pos", "label", "conc", "unit", "intensity", F.coalesce("below_dl", F.lit(False)).alias("below_dl"), "dl", "rsd_pct")
    return samples.join(analytes(b), "batch_id").join(columns, [*KEY, "label"], "left")


def blocked_below(b: BatchFrames, samples: DataFrame, least: int, reason: str) -> DataFrame:
    """Batches with fewer than ``least`` of these samples; ``{n}`` in the reason is how many there are."""
    n = samples.groupBy("batch_id").agg(F.count("*").alias("n"))
    counted = b.batches.select("batch_id").join(n, "batch_id", "left").select("batch_id", F.coalesce("n", F.lit(0)).alias("n"))
    before, _, after = reason.partition("{n}")
    text = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)) if "{n}" in reason else F.lit(reason)
    return counted.where(F.col("n") < least).select("batch_id", text.alias("reason"))


def unblocked(details: DataFrame, blocked: DataFrame) -> DataFrame:
    """Details of the batches that can be evaluated."""
    return details.join(blocked.select("batch_id"), "batch_id", "left_anti")


def recovered(expected: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Recovery, bound of censored results, and ok, of a row with conc, below_dl and dl."""
    known = expected.isNotNull() & (expected != 0)
    pct = F.when(known, F.try_divide(F.col("conc") * 100, expected))
    bound = F.when(known & F.col("conc").isNull() & F.col("below_dl"), F.try_divide(F.col("dl") * 100, expected))
    return pct, bound, F.when(pct.isNotNull(), ~F.isnan(pct) & pct.between(lo, hi)).when(bound < lo, F.lit(False))


def blank_ok(limit: Column) -> Column:
    """Whether a blank is below its limit; a non-detect whose own limit is higher isn't decided."""
    return F.when(F.col("conc").isNotNull(), F.abs("conc") < limit).when(F.coalesce("below_dl", F.lit(False)) & (F.col("dl") <= limit), F.lit(True))


def recovery(rows: DataFrame, expected: Column, lo: Column, hi: Column) -> DataFrame:
    """``recovery_pct`` (not rounded), ``bound_pct`` of censored results, and ``ok``.

    A non-detect fails only if even its limit would be below the window.
    """
    known = expected.isNotNull() & (expected != 0)
    pct, bound, ok = recovered(expected, lo, hi)
    note = (
        F.when(~known, F.lit("no expected level in export"))
        .when(F.col("conc").isNotNull(), F.lit(None).cast("string"))
        .when(~F.coalesce("below_dl", F.lit(False)), F.lit("no result"))
        .when(F.col("dl").isNull(), F.lit("non-detect, no limit quoted"))
        .when(bound < lo, F.concat(F.lit("non-detect: recovery is at most "), F.format_number(bound, 1), F.lit("%")))
        .otherwise(F.concat(F.lit("non-detect with a limit allowing up to "), F.format_number(bound, 1), F.lit("%: indeterminate")))
    )
    return rows.withColumns({"recovery_pct": pct, "bound_pct": bound, "ok": ok, "note": note})


def rpd(a: Column, b: Column) -> Column:
    """Relative percent difference."""
    return F.try_divide(F.abs(a - b) * 100, (a + b) / 2)
