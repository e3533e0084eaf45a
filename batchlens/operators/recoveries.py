"""Checks of known concentrations and of blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.functions.stats import pearson
from batchlens.functions.units import converted
from batchlens.model import ANALYSIS_TYPES, BatchFrames, carries
from batchlens.operators.base import Check, analytes, blank_limit, blank_ok, blocked_below, every_result, loq, recovery, unblocked, window
from batchlens.operators.names import matched_names

_ROW = ["batch_id", "row_pos", "name", "label"]


def _recovered(b: BatchFrames, params: dict, types: tuple[str, ...], missing: str, default=(90, 110)) -> Check:
    lo, hi = window(params, default=default)
    samples = b.of_type(*types)
    leveled = samples.where("level is not null and level <> 0")
    rows = recovery(every_result(b, leveled), F.col("level"), F.lit(lo), F.lit(hi)).select(*_ROW, "recovery_pct", "bound_pct", "ok", "note")
    bare = samples.where("level is null or level = 0").select(
        "batch_id", "row_pos", "name", F.lit("-").alias("label"), F.lit(None).cast("double").alias("recovery_pct"), F.lit(None).cast("double").alias("bound_pct"),
        F.lit(None).cast("boolean").alias("ok"), F.lit("no expected level in export").alias("note"),
    )
    return Check(rows.unionByName(bare), blocked_below(b, samples, 1, missing))


def icv_recovery(b: BatchFrames, params: dict) -> Check:
    """Recovery of initial calibration verifications."""
    return _recovered(b, params, ("ICV",), "no ICV samples in batch")


def ccv_recovery(b: BatchFrames, params: dict) -> Check:
    """Recovery of every continuing calibration verification."""
    return _recovered(b, params, ("CCV",), "no CCV samples in batch")


def lcs_recovery(b: BatchFrames, params: dict) -> Check:
    """Recovery of laboratory control samples."""
    return _recovered(b, params, ("LCS",), "no LCS in batch", (80, 120))


def standards(b: BatchFrames) -> DataFrame:
    """Calibration standards with a level other than 0."""
    return b.of_type("CAL_STD").where("level is not null and level <> 0")


def cal_linearity(b: BatchFrames, params: dict) -> Check:
    """Pearson's r of concentration against level, per analyte; 0.0 where either is constant."""
    rows = every_result(b, standards(b)).where("conc is not null")
    r = rows.groupBy("batch_id", "label").agg(F.count("*").alias("n"), pearson(F.col("conc"), F.col("level")).alias("r"))
    every = analytes(b).select("batch_id", "label").join(r, ["batch_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= 3
    out = every.select("batch_id", "label", "n", F.when(enough, F.col("r")).alias("r"), F.when(enough, F.col("r") >= params.get("min_r", 0.998)).alias("ok"))
    blocked = blocked_below(b, standards(b), 3, "need >=3 cal standards with levels, found {n}")
    return Check(unblocked(out, blocked), blocked)


def cal_back_calc(b: BatchFrames, params: dict) -> Check:
    """Every standard recovers its level; the lowest level has a wider window."""
    (lo, hi), (llo, lhi), least = window(params), window(params, "low_window_pct", (70, 130)), params.get("min_levels", 3)
    std = standards(b).withColumn("lowest_level", F.col("level") == F.min("level").over(W.partitionBy("batch_id")))
    low = F.col("lowest_level")
    rows = recovery(every_result(b, std), F.col("level"), F.when(low, llo).otherwise(F.lit(lo)), F.when(low, lhi).otherwise(F.lit(hi)))
    blocked = blocked_below(b, standards(b), least, f"need >={least} cal standards with levels, found {{n}}")
    return Check(unblocked(rows.select(*_ROW, "level", "lowest_level", "recovery_pct", "bound_pct", "ok", "note"), blocked), blocked)


def cal_low_std(b: BatchFrames, params: dict) -> Check:
    """The first of the lowest standards recovers."""
    lo, hi = window(params, default=(70, 130))
    first = W.partitionBy("batch_id").orderBy("level", "row_pos")
    low = standards(b).withColumn("rank", F.row_number().over(first)).where("rank = 1")
    rows = recovery(every_result(b, low), F.col("level"), F.lit(lo), F.lit(hi)).select(*_ROW, "level", "recovery_pct", "bound_pct", "ok", "note")
    return Check(rows, blocked_below(b, standards(b), 1, "no cal standards with levels"))


def cal_heteroscedasticity(b: BatchFrames, params: dict) -> Check:
    """Median relative error of the lower half of the standards against that of the upper half."""
    least, most, floor = params.get("min_levels", 4), params.get("max_ratio", 3.0), params.get("min_low_err_pct", 10.0)
    strict = params.get("on_exceed", "warn") == "fail"
    by = W.partitionBy("batch_id")
    std = standards(b).withColumns({"i": F.row_number().over(by.orderBy("level", "row_pos")), "n": F.count("*").over(by)})
    half = F.floor(F.col("n") / 2)
    side = F.when(F.col("i") <= half, "low").when(F.col("i") > F.col("n") - half, "high")
    rows = every_result(b, std.withColumn("side", side).where("side is not null")).withColumn("err", F.try_divide(F.abs(F.col("conc") - F.col("level")), F.col("level")) * 100)
    low, high = (F.when((F.col("side") == s) & F.col("err").isNotNull(), F.col("err")) for s in ("low", "high"))
    g = rows.groupBy("batch_id", "label").agg(F.count(low).alias("n_low"), F.count(high).alias("n_high"), F.median(low).alias("low_err_pct"), F.median(high).alias("high_err_pct"))
    decided = (F.col("n_low") >= 2) & (F.col("n_high") >= 2)
    ratio = F.when(decided & (F.col("high_err_pct") > 0), F.col("low_err_pct") / F.col("high_err_pct"))
    flagged = F.coalesce((ratio > most) & (F.col("low_err_pct") >= floor), F.lit(False))
    ok = F.when(~decided | ratio.isNull(), F.lit(None)).when(flagged, F.lit(False) if strict else F.lit(None)).otherwise(F.lit(True)).cast("boolean")
    out = g.select("batch_id", "label", "n_low", "n_high", "low_err_pct", "high_err_pct", ratio.alias("ratio"), flagged.alias("flagged"), ok.alias("ok"))
    blocked = blocked_below(b, standards(b), least, f"need >={least} cal standards with levels, found {{n}}")
    out = unblocked(out, blocked)
    return Check(out, blocked, _flag_verdict(out, "flagged", strict, "analyte(s) whose low standards scatter far more than the high ones"))


def _flag_verdict(details: DataFrame, flag: str, strict: bool, text: str) -> DataFrame:
    """FAIL or WARN for batches with flagged rows; others follow the common rule."""
    n = details.groupBy("batch_id").agg(F.count_if(F.col(flag)).alias("n")).where("n > 0")
    return n.select("batch_id", F.lit("FAIL" if strict else "WARN").alias("outcome"), F.concat(F.col("n").cast("string"), F.lit(" " + text)).alias("reason"))


def ccv_frequency(b: BatchFrames, params: dict) -> Check:
    """Not more than ``every_n`` analyses between verifications, and one at the end of the run."""
    most, end = params.get("every_n", 10), params.get("end_of_run", True)
    before = W.partitionBy("batch_id").orderBy("row_pos").rowsBetween(W.unboundedPreceding, -1)
    segment = F.coalesce(F.sum((F.col("type") == "CCV").cast("long")).over(before), F.lit(0)) + 1
    seg = b.samples.withColumn("segment", segment).groupBy("batch_id", "segment").agg(
        F.count_if(F.col("type").isin(*ANALYSIS_TYPES)).alias("analyses"), F.bool_or(F.col("type") == "CCV").alias("closed")
    )
    ok = F.when(F.col("closed"), F.col("analyses") <= most).otherwise(F.lit(False if end else None).cast("boolean"))
    rows = seg.where("closed or analyses > 0").select("batch_id", "segment", "analyses", "closed", F.lit(most).cast("long").alias("every_n"), ok.alias("ok"))
    blocked = blocked_below(b, b.of_type("CCV"), 1, "no CCV samples in batch")
    return Check(unblocked(rows, blocked), blocked)


def _blanks(b: BatchFrames, params: dict, types: tuple[str, ...], missing: str) -> Check:
    rows = every_result(b, b.of_type(*types)).withColumn("limit_ppb", blank_limit(params, F.col("label")).cast("double"))
    absent = F.col("conc").isNull() & ~F.coalesce("below_dl", F.lit(False))
    ok = blank_ok(F.col("limit_ppb"))
    rows = rows.select(*_ROW, "conc", F.when(~absent, F.col("limit_ppb")).alias("limit_ppb"), F.when(F.col("conc").isNull(), F.col("dl")).alias("dl"), ok.alias("ok"))
    return Check(rows, blocked_below(b, b.of_type(*types), 1, missing))


def icb_ccb_blank(b: BatchFrames, params: dict) -> Check:
    """Calibration blanks below the limit."""
    return _blanks(b, params, ("ICB", "CCB"), "no ICB/CCB samples in batch")


def method_blank(b: BatchFrames, params: dict) -> Check:
    """Method blanks below the limit."""
    return _blanks(b, params, ("MB",), "no method blank in batch")


def blank_derived_lod(b: BatchFrames, params: dict) -> Check:
    """What the scatter of blanks after calibration says about the configured limit of quantitation."""
    known = [t for t in params.get("blank_types", ["ICB", "CCB"]) if t in ("ICB", "CCB", "MB", "CAL_BLANK")]
    least, k_lod, k_loq, strict = params.get("min_n", 3), params.get("k_lod", 3), params.get("k_loq", 10), params.get("on_exceed", "warn") == "fail"
    if not known:
        reason = F.concat(F.lit("no usable blank types configured (unrecognized: "), F.lit(", ".join(params.get("blank_types", []))), F.lit(")"))
        none = b.batches.select("batch_id", reason.alias("reason"))
        return Check(b.batches.select("batch_id", F.lit(True).alias("ok")).limit(0), none)
    blanks = b.of_type(*known)
    if params.get("after_calibration", True):
        last = b.of_type("CAL_STD").groupBy("batch_id").agg(F.max("seq_index").alias("last_cal"))
        blanks = blanks.join(last, "batch_id", "left").where("last_cal is null or seq_index > last_cal")
    rows = every_result(b, blanks).groupBy("batch_id", "label").agg(F.count("conc").alias("n"), F.stddev_samp("conc").alias("sd"))
    rows = rows.withColumns({"configured_loq": loq(params, F.col("label")).cast("double"), "sd": F.when(F.col("n") >= least, F.col("sd"))})
    rows = rows.withColumns({"derived_lod": F.col("sd") * k_lod, "derived_loq": F.col("sd") * k_loq})
    over = F.coalesce(F.col("derived_loq") > F.col("configured_loq"), F.lit(False))
    ok = F.when(F.col("sd").isNull(), F.lit(None)).when(over, F.lit(False) if strict else F.lit(None)).otherwise(F.lit(True)).cast("boolean")
    out = rows.withColumns({"over": over, "ok": ok})
    blocked = blocked_below(b, blanks, least, f"need >={least} post-calibration blanks of type {'/'.join(known)}, found {{n}}")
    out = unblocked(out, blocked)
    verdict = _flag_verdict(out, "over", strict, "analyte(s) whose blank scatter implies an LOQ above the configured value")
    return Check(out, blocked, verdict, "no analyte has enough numeric blanks")


def crm_recovery(b: BatchFrames, params: dict, values: DataFrame, patterns: DataFrame) -> Check:
    """Recovery of certified elements in samples whose name matches a reference material (the first in the library).

    ``values``: lib_pos, crm_id, unit, element, value, uncertainty, value_type; ``patterns``: lib_pos, crm_id, pattern (Java syntax).
    Each distinct name is matched once, and only with patterns whose text it holds; samples that carry their results stay where they are and
    are matched with all patterns in turn. The values of the library, which the driver loads, go to every task: by material and element all results of one would meet in one.
    """
    lo, hi = window(params, default=(80, 120))
    library = patterns.collect()
    if carries(b.samples):
        first = sorted((r["lib_pos"], r["crm_id"], r["pattern"]) for r in library if r["pattern"] is not None)
        found = [F.when(F.col("name").rlike(p), F.struct(F.lit(pos).alias("lib_pos"), F.lit(crm_id).alias("crm_id"))) for pos, crm_id, p in first]
        hits = b.samples.withColumn("m", F.coalesce(*found)).where("m is not null") if found else b.samples.withColumn("m", F.struct(F.lit(0).alias("lib_pos"), F.lit("").alias("crm_id"))).limit(0)
        hits = hits.select("batch_id", "row_pos", "name", "m.lib_pos", "m.crm_id", "results")
    else:
        named = matched_names(b.samples.select("name").distinct(), patterns).groupBy("name").agg(F.min(F.struct("lib_pos", "crm_id")).alias("m"))
        hits = b.samples.join(named, "name").select("batch_id", "row_pos", "name", "m.lib_pos", "m.crm_id")
    rows = every_result(b, hits).join(F.broadcast(values.drop("crm_id").withColumnRenamed("unit", "certified_unit")), ["lib_pos", "element"])
    expected = converted(F.col("value"), F.col("certified_unit"), F.coalesce("unit", F.lit("ppb")))
    rows = recovery(rows.withColumn("expected", expected), F.col("expected"), F.lit(lo), F.lit(hi))
    ok = F.when(F.col("value_type") != "information", F.col("ok"))
    within = F.abs(F.col("conc") - F.col("expected")) <= converted(F.col("uncertainty"), F.col("certified_unit"), F.coalesce("unit", F.lit("ppb")))
    out = rows.select(*_ROW, "crm_id", "element", "expected", "recovery_pct", within.alias("within_ref_uncert"), ok.alias("ok"))
    ids = sorted({r["crm_id"] for r in library})
    reason = f"no sample name matched any of the {len(ids)} material(s) in the library ({', '.join(ids)})" if ids else "CRM library is empty"
    return Check(out, blocked_below(b, hits, 1, reason))
