"""The catalog of checks, and what a rule pack makes of their rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.model import BatchFrames, cut
from batchlens.operators import pairs, recoveries
from batchlens.operators.base import Check
from batchlens.plans.packs import load_pack
from batchlens.sources.crm import library_frames

CATALOG: dict[str, Callable[[BatchFrames, dict], Check]] = {
    "cal_linearity": recoveries.cal_linearity,
    "cal_back_calc": recoveries.cal_back_calc,
    "cal_heteroscedasticity": recoveries.cal_heteroscedasticity,
    "cal_low_std": recoveries.cal_low_std,
    "icv_recovery": recoveries.icv_recovery,
    "ccv_recovery": recoveries.ccv_recovery,
    "ccv_frequency": recoveries.ccv_frequency,
    "icb_ccb_blank": recoveries.icb_ccb_blank,
    "method_blank": recoveries.method_blank,
    "blank_derived_lod": recoveries.blank_derived_lod,
    "precision_rsd": pairs.precision_rsd,
    "instrument_flags": pairs.instrument_flags,
    "istd_recovery": pairs.istd_recovery,
    "lcs_recovery": recoveries.lcs_recovery,
    "quant_crosscheck": pairs.quant_crosscheck,
    "crm_recovery": lambda b, p: recoveries.crm_recovery(b, p, *library_frames(b.batches.sparkSession, p.get("library", "crm"))),
    "dup_rpd": pairs.dup_rpd,
    "ms_msd": pairs.ms_msd,
    "serial_dilution": pairs.serial_dilution,
    "oes_line_agreement": pairs.oes_line_agreement,
    "seq_structure": pairs.seq_structure,
}


def outcomes(b: BatchFrames, check: Check) -> DataFrame:
    """batch_id, outcome, reason of one check for every batch: PASS, FAIL, WARN or NOT_EVALUATED."""
    n = check.details.groupBy("batch_id").agg(F.count_if(F.col("ok") == F.lit(False)).alias("failing"), F.count("ok").alias("decided"))
    out = b.batches.select("batch_id").join(n, "batch_id", "left")
    if check.verdict is not None:
        own = check.verdict.select("batch_id", F.col("outcome").alias("own"), F.col("reason").alias("own_reason"))
    else:
        own = b.batches.select("batch_id", F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("own_reason")).limit(0)
    first = check.blocked.groupBy("batch_id").agg(F.min("reason").alias("blocked"))
    out = out.join(own, "batch_id", "left").join(first, "batch_id", "left")
    failing, decided = F.coalesce("failing", F.lit(0)), F.coalesce("decided", F.lit(0))
    outcome = F.when(F.col("blocked").isNotNull(), "NOT_EVALUATED").when(F.col("own").isNotNull(), F.col("own")).when(failing > 0, "FAIL").when(decided == 0, "WARN").otherwise("PASS")
    reason = (
        F.when(F.col("blocked").isNotNull(), F.col("blocked")).when(F.col("own").isNotNull(), F.col("own_reason"))
        .when(failing > 0, F.concat(failing.cast("string"), F.lit(" failing row(s)"))).when(decided == 0, F.lit(check.undecided)).otherwise(F.lit(""))
    )
    return out.select("batch_id", outcome.alias("outcome"), reason.alias("reason"))


def folded(b: BatchFrames, checks: dict[str, Check]) -> DataFrame:
    """batch_id, check_id, outcome, reason of all these checks, by the rules of ``outcomes``.

    All rows that decide (details, blocks, own verdicts, and an empty one for each batch and check) are one table with one aggregate
    over batch and check, so folding any number of checks takes one exchange and no join.
    """
    none = F.lit(None).cast("string")
    parts = [b.batches.select("batch_id", F.explode(F.array(*map(F.lit, checks))).alias("check_id"), F.lit(None).cast("boolean").alias("ok"), none.alias("blocked"), none.alias("own"), none.alias("own_reason"))]
    for check_id, check in checks.items():
        row = lambda df, ok=F.lit(None).cast("boolean"), blocked=none, own=none, why=none, of=check_id: parts.append(df.select("batch_id", F.lit(of).alias("check_id"), ok.alias("ok"), blocked.alias("blocked"), own.alias("own"), why.alias("own_reason")))
        row(check.details, ok=F.col("ok"))
        row(check.blocked, blocked=F.col("reason"))
        if check.verdict is not None:
            row(check.verdict, own=F.col("outcome"), why=F.col("reason"))
    n = reduce(DataFrame.unionByName, parts).groupBy("batch_id", "check_id").agg(
        F.count_if(F.col("ok") == F.lit(False)).alias("failing"), F.count("ok").alias("decided"), F.min("blocked").alias("blocked"), F.max("own").alias("own"), F.max("own_reason").alias("own_reason")
    )
    return settled(n, {k: c.undecided for k, c in checks.items()})


def settled(n: DataFrame, undecided: dict[str, str]) -> DataFrame:
    """batch_id, check_id, outcome, reason of counts of rows: failing, decided, blocked, own, own_reason."""
    undecided = F.coalesce(*[F.when(F.col("check_id") == k, text) for k, text in undecided.items()])
    outcome = F.when(F.col("blocked").isNotNull(), "NOT_EVALUATED").when(F.col("own").isNotNull(), F.col("own")).when(F.col("failing") > 0, "FAIL").when(F.col("decided") == 0, "WARN").otherwise("PASS")
    reason = (
        F.when(F.col("blocked").isNotNull(), F.col("blocked")).when(F.col("own").isNotNull(), F.col("own_reason"))
        .when(F.col("failing") > 0, F.concat(F.col("failing").cast("string"), F.lit(" failing row(s)"))).when(F.col("decided") == 0, undecided).otherwise(F.lit(""))
    )
    return n.select("batch_id", "check_id", outcome.alias("outcome"), reason.alias("reason"))


def run(b: BatchFrames, rules: str | dict = "epa6020b", settle: bool = False) -> tuple[DataFrame, DataFrame]:
    """All enabled checks of a rule pack: (results, details).

    results: batch_id, check_id, catalog_pos, outcome, reason, verify. details: batch_id, check_id, ok, payload (the
    check's own columns as JSON). A check that can't be planned is NOT_EVALUATED with its error; ids that the catalog doesn't have are ignored.
    With ``settle`` every check is also run, one after the other, and kept; an error of its rows then makes that check alone
    NOT_EVALUATED. Without it the plans stay lazy, and such an error ends the job that runs them.
    """
    pack = rules if isinstance(rules, dict) else load_pack(rules)
    results, details, planned, verify = [], [], {}, {}
    for pos, (check_id, check) in enumerate(CATALOG.items()):
        entry = pack.get("checks", {}).get(check_id)
        if entry is None or not entry.get("enabled", True):
            continue
        try:
            got = check(b, {**pack.get("shared", {}), **entry.get("params", {})})
            own = got.details.select("batch_id", F.lit(check_id).alias("check_id"), "ok", F.to_json(F.struct(*[c for c in got.details.columns if c not in ("batch_id", "ok")])).alias("payload"))
            verify[check_id] = (pos, entry.get("verify", ""))
            if not settle:
                planned[check_id] = got
                details.append(own)
                continue
            rows, own = cut(outcomes(b, got)), cut(own)
            rows.count(), own.count()
            details.append(own)
        except Exception as error:  # noqa: BLE001  a check's error is that check's result, never the run's
            rows = b.batches.select("batch_id", F.lit("NOT_EVALUATED").alias("outcome"), F.lit(f"check error: {error!r}"[:500]).alias("reason"))
        results.append(rows.select("batch_id", F.lit(check_id).alias("check_id"), F.lit(pos).alias("catalog_pos"), "outcome", "reason", F.lit(entry.get("verify", "")).alias("verify")))
    if planned:
        place, text = (F.coalesce(*[F.when(F.col("check_id") == k, v[i]) for k, v in verify.items()]) for i in (0, 1))
        results.append(folded(b, planned).select("batch_id", "check_id", place.alias("catalog_pos"), "outcome", "reason", text.alias("verify")))
    if not results:
        raise ValueError("the rule pack enables no check")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(results), union(details) if details else b.batches.select("batch_id", F.lit("").alias("check_id"), F.lit(True).alias("ok"), F.lit("").alias("payload")).limit(0)


def verdict(results: DataFrame) -> DataFrame:
    """batch_id, verdict, exit_code: FAIL (2) if any check fails, else PASS (0)."""
    failed = F.bool_or(F.col("outcome") == "FAIL")
    return results.groupBy("batch_id").agg(F.when(failed, "FAIL").otherwise("PASS").alias("verdict"), F.when(failed, 2).otherwise(0).alias("exit_code"))
