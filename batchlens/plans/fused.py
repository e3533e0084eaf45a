"""The outcomes of all checks with the results scanned once for the checks that judge results one by one or by analyte.

Eleven of the 21 checks look at a result, its sample and its analyte only. What they need is one aggregate state a batch and analyte: how many
results fail and are decided, sums for a correlation, medians, deviations. The state of all eleven is one aggregate over
one join of samples, analytes and results; what a check needs of its sample's place in the batch (the lowest standard, the end of
calibration) are windows over the samples alone. The other checks (parents, lines, sequence, recomputed quantities) keep their own plans, and all are folded together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.functions.stats import count_if, pearson
from batchlens.model import SAMPLE_TYPES, BatchFrames
from batchlens.operators.base import Check, blank_limit, blank_ok, every_result, loq, recovered, window
from batchlens.operators.pairs import assessed
from batchlens.plans.engine import CATALOG, folded, settled

# Types, default windows and reasons of the checks, as in their own plans.
_RECOVERED = {"icv_recovery": ("ICV", (90, 110), "no ICV samples in batch"), "ccv_recovery": ("CCV", (90, 110), "no CCV samples in batch"), "lcs_recovery": ("LCS", (80, 120), "no LCS in batch")}
_BLANKS = {"icb_ccb_blank": (("ICB", "CCB"), "no ICB/CCB samples in batch"), "method_blank": (("MB",), "no method blank in batch")}
_SCATTER = "analyte(s) whose low standards scatter far more than the high ones"
_IMPLIED = "analyte(s) whose blank scatter implies an LOQ above the configured value"
FUSED = ("cal_linearity", "cal_back_calc", "cal_low_std", "cal_heteroscedasticity", *_RECOVERED, *_BLANKS, "blank_derived_lod", "precision_rsd")
_UNDECIDED = {"blank_derived_lod": "no analyte has enough numeric blanks", "precision_rsd": "no result has enough signal to judge its precision"}


class _State:
    """What is added up, by analyte and then by batch, for the checks of one pack."""

    def __init__(self):
        self.of_samples: dict[str, Column] = {}  # counts of a batch's samples
        self.of_analytes: dict[str, Column] = {}  # aggregates of an analyte's results
        self.of_batches: dict[str, Column] = {}  # aggregates of a batch's analytes
        self.rows: list[Column] = []

    def judged(self, check: str, where: Column, ok: Column) -> None:
        """Results that are judged one by one."""
        self.of_analytes |= {f"{check}_f": count_if(where & ~ok), f"{check}_d": count_if(where & ok.isNotNull())}
        self.of_batches |= {f"{check}_f": F.sum(f"{check}_f"), f"{check}_d": F.sum(f"{check}_d")}

    def by_analyte(self, check: str, ok: Column, flagged: Column | None = None) -> None:
        """Analytes that are judged by their aggregates."""
        self.of_batches |= {f"{check}_f": count_if(~ok), f"{check}_d": count_if(ok.isNotNull())}
        if flagged is not None:
            self.of_batches[f"{check}_g"] = count_if(flagged)

    def row(self, check: str, blocked: Column, own: Column | None = None, reason: Column | None = None) -> None:
        none = F.lit(None).cast("string")
        of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        self.rows.append(F.struct(F.lit(check).alias("check_id"), of(f"{check}_f").alias("failing"), of(f"{check}_d").alias("decided"), blocked.alias("blocked"), (none if own is None else own).alias("own"), (none if reason is None else reason).alias("own_reason")))


def _few(n: str, least: int, text: str) -> Column:
    """The reason of a batch with fewer of these samples; ``{n}`` is how many there are."""
    count = F.coalesce(F.col(n), F.lit(0))
    before, mark, after = text.partition("{n}")
    return F.when(count < least, F.concat(F.lit(before), count.cast("string"), F.lit(after)) if mark else F.lit(text))


def _flagged(check: str, strict: bool, text: str) -> tuple[Column, Column]:
    n = F.coalesce(F.col(f"{check}_g"), F.lit(0))
    return F.when(n > 0, "FAIL" if strict else "WARN"), F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + text)))


def fused_outcomes(b: BatchFrames, params: dict[str, dict]) -> DataFrame:
    """batch_id, check_id, outcome, reason of those of the checks in ``params`` that are in ``FUSED``."""
    by, s = W.partitionBy("batch_id"), _State()
    is_std = (F.col("type") == "CAL_STD") & F.coalesce(F.col("level") != 0, F.lit(False))
    samples = b.samples.withColumn("std", is_std)
    samples = samples.withColumns({
        "i": F.when(F.col("std"), F.row_number().over(W.partitionBy("batch_id", "std").orderBy("level", "row_pos"))), "n_std": count_if(F.col("std")).over(by),
        "lowest": F.col("std") & (F.col("level") == F.min(F.when(F.col("std"), F.col("level"))).over(by)), "last_cal": F.max(F.when(F.col("type") == "CAL_STD", F.col("seq_index"))).over(by),
    })
    std = F.col("std")
    s.of_samples["n_std"] = count_if(std)

    for check, (kind, default, missing) in _RECOVERED.items():
        if check in params:
            lo, hi = map(F.lit, window(params[check], default=default))
            s.of_samples[check] = count_if(F.col("type") == kind)
            s.judged(check, (F.col("type") == kind) & F.coalesce(F.col("level") != 0, F.lit(False)), recovered(F.col("level"), lo, hi)[2])
            s.row(check, _few(check, 1, missing))
    for check, (kinds, missing) in _BLANKS.items():
        if check in params:
            s.of_samples[check] = count_if(F.col("type").isin(*kinds))
            s.judged(check, F.col("type").isin(*kinds), blank_ok(blank_limit(params[check], F.col("label")).cast("double")))
            s.row(check, _few(check, 1, missing))
    if (p := params.get("cal_linearity")) is not None:
        used = std & F.col("conc").isNotNull()
        s.of_analytes |= {"lin_n": count_if(used), "lin_r": pearson(F.when(used, F.col("conc")), F.when(used, F.col("level")))}
        s.by_analyte("cal_linearity", F.when(F.col("lin_n") >= 3, F.col("lin_r") >= p.get("min_r", 0.998)))
        s.row("cal_linearity", _few("n_std", 3, "need >=3 cal standards with levels, found {n}"))
    if (p := params.get("cal_back_calc")) is not None:
        (lo, hi), (llo, lhi), least = window(p), window(p, "low_window_pct", (70, 130)), p.get("min_levels", 3)
        edge = lambda low, other: F.when(F.col("lowest"), low).otherwise(F.lit(other))
        s.judged("cal_back_calc", std, recovered(F.col("level"), edge(llo, lo), edge(lhi, hi))[2])
        s.row("cal_back_calc", _few("n_std", least, f"need >={least} cal standards with levels, found {{n}}"))
    if (p := params.get("cal_low_std")) is not None:
        lo, hi = map(F.lit, window(p, default=(70, 130)))
        s.judged("cal_low_std", std & (F.col("i") == 1), recovered(F.col("level"), lo, hi)[2])
        s.row("cal_low_std", _few("n_std", 1, "no cal standards with levels"))
    if (p := params.get("cal_heteroscedasticity")) is not None:
        least, strict, half = p.get("min_levels", 4), p.get("on_exceed", "warn") == "fail", F.floor(F.col("n_std") / 2)
        err = F.try_divide(F.abs(F.col("conc") - F.col("level")), F.col("level")) * 100
        low, high = F.when(std & (F.col("i") <= half), err), F.when(std & (F.col("i") > F.col("n_std") - half), err)
        s.of_analytes |= {"het_nl": F.count(low), "het_nh": F.count(high), "het_l": F.median(low), "het_h": F.median(high)}
        ratio = F.when((F.col("het_nl") >= 2) & (F.col("het_nh") >= 2) & (F.col("het_h") > 0), F.col("het_l") / F.col("het_h"))
        over = F.coalesce((ratio > p.get("max_ratio", 3.0)) & (F.col("het_l") >= p.get("min_low_err_pct", 10.0)), F.lit(False))
        s.by_analyte("cal_heteroscedasticity", F.when(ratio.isNotNull(), F.when(over, F.lit(False if strict else None)).otherwise(F.lit(True)).cast("boolean")), over)
        s.row("cal_heteroscedasticity", _few("n_std", least, f"need >={least} cal standards with levels, found {{n}}"), *_flagged("cal_heteroscedasticity", strict, _SCATTER))
    known = [t for t in params.get("blank_derived_lod", {}).get("blank_types", ["ICB", "CCB"]) if t in ("ICB", "CCB", "MB", "CAL_BLANK")]
    if (p := params.get("blank_derived_lod")) is not None and known:
        least, strict = p.get("min_n", 3), p.get("on_exceed", "warn") == "fail"
        blank = F.col("type").isin(*known)
        if p.get("after_calibration", True):
            blank &= F.col("last_cal").isNull() | F.coalesce(F.col("seq_index") > F.col("last_cal"), F.lit(False))
        s.of_samples["n_lod"] = count_if(blank)
        s.of_analytes |= {"lod_n": F.count(F.when(blank, F.col("conc"))), "lod_sd": F.stddev_samp(F.when(blank, F.col("conc"))), "lod_loq": F.first(loq(p, F.col("label")).cast("double"))}
        sd = F.when(F.col("lod_n") >= least, F.col("lod_sd"))
        over = F.coalesce(sd * p.get("k_loq", 10) > F.col("lod_loq"), F.lit(False))
        s.by_analyte("blank_derived_lod", F.when(sd.isNotNull(), F.when(over, F.lit(False if strict else None)).otherwise(F.lit(True)).cast("boolean")), over)
        s.row("blank_derived_lod", _few("n_lod", least, f"need >={least} post-calibration blanks of type {'/'.join(known)}, found {{n}}"), *_flagged("blank_derived_lod", strict, _IMPLIED))
    if (p := params.get("precision_rsd")) is not None:
        if bad := [t for t in p.get("types") or [] if t not in SAMPLE_TYPES]:
            raise ValueError(f"unknown sample types: {bad}")
        wanted = F.col("type").isin(*p["types"]) if p.get("types") else F.lit(True)
        used = wanted & assessed(p)
        s.of_analytes |= {"rsd_n": count_if(used), "rsd_over": count_if(used & (F.col("rsd_pct") > float(p.get("max_rsd_pct", 5.0)))), "rsd_any": F.count("rsd_pct")}
        s.of_batches["rsd_any"] = F.sum("rsd_any")
        s.by_analyte("precision_rsd", F.when(F.col("rsd_n") > 0, F.col("rsd_over") == 0))
        s.row("precision_rsd", _few("rsd_any", 1, "no %RSD columns in this export"))

    every = every_result(b, samples).groupBy("batch_id", "label").agg(*(c.alias(n) for n, c in s.of_analytes.items()))
    judged = every.groupBy("batch_id").agg(*(c.alias(n) for n, c in s.of_batches.items()))
    counts = samples.groupBy("batch_id").agg(*(c.alias(n) for n, c in s.of_samples.items()))
    n = b.batches.select("batch_id").join(counts.withColumnsRenamed({k: f"n_{k}" for k in s.of_samples if k in FUSED}), "batch_id", "left").join(judged, "batch_id", "left")
    n = n.withColumnsRenamed({f"n_{k}": k for k in s.of_samples if k in FUSED})
    return settled(n.select("batch_id", F.inline(F.array(*s.rows))), {c: _UNDECIDED.get(c, Check.undecided) for c in FUSED})


def all_outcomes(b: BatchFrames, params: dict[str, dict], checks: dict | None = None) -> DataFrame:
    """batch_id, check_id, outcome, reason of all checks in ``params``; ``checks`` may replace some of the catalog's."""
    known = CATALOG | (checks or {})
    own = {c for c in params if c not in FUSED or (c in (checks or {}) and checks[c] is not CATALOG[c])}
    if "blank_derived_lod" in params and not [t for t in params["blank_derived_lod"].get("blank_types", ["ICB", "CCB"]) if t in ("ICB", "CCB", "MB", "CAL_BLANK")]:
        own.add("blank_derived_lod")
    fused = {c: p for c, p in params.items() if c not in own}
    parts = [fused_outcomes(b, fused)] if fused else []
    parts += [folded(b, {c: known[c](b, params[c]) for c in params if c in own})] if own else []
    return reduce(DataFrame.unionByName, parts)
