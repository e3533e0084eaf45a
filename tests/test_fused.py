"""Outcomes from one aggregate state against the outcomes of each check's own plan."""

import pytest
from exports import wide_export

from batchlens.model import BatchFrames
from batchlens.plans.engine import CATALOG, folded, outcomes
from batchlens.plans.fused import FUSED, all_outcomes, fused_outcomes
from batchlens.plans.packs import load_pack
from batchlens.sources.wide import read_wide


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fused")
    drop = {(f"Cal Std {x} ppb", "Type"): "Sample" for x in (1, 5, 10, 50)}
    odd = {("Cal Std 1 ppb", "9 Be Conc. [ppb]"): "<0.5", ("Cal Std 5 ppb", "9 Be Conc. [ppb]"): "", ("ICB", "52 Cr [He] Conc. [ppb]"): "<5", ("ICV-50", "Level [ppb]"): "", ("LCS-25", "Type"): "Sample"}
    wide_export(str(folder / "pass.csv"))
    wide_export(str(folder / "fail.csv"), violations=True)
    wide_export(str(folder / "odd.csv"), edits=odd)
    wide_export(str(folder / "few.csv"), edits=drop | {(n, "Type"): "Sample" for n in ("ICB", "MB-1", "ICV-50", "CCB #1", "CCB #2", "CCB #3")})
    return read_wide(spark, [str(folder / f"{n}.csv") for n in ("pass", "fail", "odd", "few")]).cached()


def params(**own):
    pack = load_pack("epa6020b")
    return {c: {**pack.get("shared", {}), **e.get("params", {}), **own.get(c, {})} for c, e in pack["checks"].items()}


STRICT = {"cal_heteroscedasticity": {"on_exceed": "fail", "max_ratio": 0.5, "min_low_err_pct": 0.01}, "blank_derived_lod": {"on_exceed": "fail", "after_calibration": False, "blank_types": ["ICB", "CCB", "MB"]}, "precision_rsd": {"types": ["SAMPLE", "CCV"], "max_rsd_pct": 0.5, "min_intensity_cps": None}, "method_blank": {"limit": "1/2 LOQ"}}


@pytest.mark.parametrize("own", [{}, STRICT, {"blank_derived_lod": {"blank_types": ["odd"]}}])
def test_fused_outcomes_equal_those_of_each_check(spark, batches, own):
    p = params(**own)
    got = {(r["batch_id"], r["check_id"]): (r["outcome"], r["reason"]) for r in all_outcomes(batches, p).collect()}
    apart = folded(batches, {c: CATALOG[c](batches, v) for c, v in p.items()}).collect()
    expected = {(r["batch_id"], r["check_id"]): (r["outcome"], r["reason"]) for r in apart}
    assert got == expected and len(got) == 4 * 21
    for c in FUSED if own is STRICT else []:
        assert {r["batch_id"]: (r["outcome"], r["reason"]) for r in outcomes(batches, CATALOG[c](batches, p[c])).collect()} == {b: v for (b, k), v in got.items() if k == c}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_one_scan_of_the_results_and_few_exchanges(spark, batches):
    p = {c: v for c, v in params().items() if c in FUSED}
    plan = fused_outcomes(batches, p)._jdf.queryExecution().executedPlan().toString()
    results = batches.results._jdf.queryExecution().analyzed().output().mkString(",").split(",")[3]  # conc, by its id
    assert len(p) == 11 and sum("Scan" in line and results in line for line in plan.splitlines()) <= 1
    one, all_ = exchanges(fused_outcomes(batches, {"icv_recovery": p["icv_recovery"]})), exchanges(fused_outcomes(batches, p))
    apart = exchanges(folded(batches, {c: CATALOG[c](batches, v) for c, v in p.items()}))
    assert all_ <= one + 2 and 4 * all_ <= apart, (one, all_, apart)


def test_empty_batches_and_unknown_types(spark, batches):
    none = BatchFrames(*(getattr(batches, n).limit(0) for n in ("batches", "analytes", "samples", "results", "istd", "flags")))
    assert fused_outcomes(none, params()).count() == 0
    bare = BatchFrames(batches.batches, none.analytes, none.samples, none.results, none.istd, none.flags)
    got = {r["check_id"]: r["outcome"] for r in fused_outcomes(bare, {c: v for c, v in params().items() if c in FUSED}).collect()}
    assert set(got.values()) == {"NOT_EVALUATED"} and len(got) == 11
    with pytest.raises(ValueError, match="unknown sample types"):
        fused_outcomes(batches, {"precision_rsd": {"types": ["WRONG"]}})
