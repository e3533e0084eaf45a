"""The checks over small batches made by hand, and over made-up exports."""

import pytest
from exports import wide_export
from pyspark.sql import functions as F

from batchlens.model import frames
from batchlens.operators import pairs, recoveries
from batchlens.plans.engine import CATALOG, outcomes, run, verdict
from batchlens.plans.packs import load_pack
from batchlens.sources.crm import PATTERNS, VALUES
from batchlens.sources.wide import read_wide

LOQ = {"loq_ppb": {"default": 0.1}}


def batch(spark, samples, labels=("A",), results=(), **more):
    """samples: (name, type, level, parent); results: (row_pos, label, conc, intensity, below_dl, dl, rsd)."""
    return frames(
        spark,
        batches=[("b", "x", "t", "f", True, [])],
        analytes=[("b", i + 1, "analyte", x, None, "Cr", None, None, 200.0 + i) for i, x in enumerate(labels)] + list(more.get("istds", ())),
        samples=[("b", i + 1, i + 1, n, t, lv, p, None, []) for i, (n, t, lv, p) in enumerate(samples)],
        results=[("b", pos, label, conc, "ppb", cps, below, dl, rsd) for pos, label, conc, cps, below, dl, rsd in results],
        istd=more.get("istd", ()),
        flags=more.get("flags", ()),
    )


def ok(check):
    return [r["ok"] for r in check.details.collect()]


def test_recovery_is_three_valued(spark):
    b = batch(spark, [(f"c{i}", "CCV", 10.0, None) for i in range(6)] + [("c", "CCV", None, None)], results=[
        (1, "A", 9.0, None, False, None, None), (2, "A", 8.99, None, False, None, None), (3, "A", None, None, True, 5.0, None), (4, "A", None, None, True, 9.5, None), (5, "A", None, None, True, None, None),
    ])
    rows = {r["row_pos"]: r for r in recoveries.ccv_recovery(b, {"window_pct": [90, 110]}).details.collect()}
    assert [rows[i]["ok"] for i in range(1, 8)] == [True, False, False, None, None, None, None]
    assert rows[7]["note"] == "no expected level in export" and rows[6]["note"] == "no result" and "at most 50.0" in rows[3]["note"]


def test_cadence_counts_to_the_end_of_the_run(spark):
    rows = [("s", "SAMPLE", None, None)] * 3 + [("c", "CCV", 1.0, None)] * 2 + [("s", "SAMPLE", None, None)]
    got = sorted((r["segment"], r["analyses"], r["ok"]) for r in recoveries.ccv_frequency(batch(spark, rows), {"every_n": 2}).details.collect())
    assert got == [(1, 3, False), (2, 0, True), (3, 1, False)]
    got = [r["ok"] for r in recoveries.ccv_frequency(batch(spark, rows), {"every_n": 2, "end_of_run": False}).details.orderBy("segment").collect()]
    assert got == [False, True, None]


def test_linearity_of_a_constant_is_zero(spark):
    b = batch(spark, [("s", "CAL_STD", float(x), None) for x in (1, 2, 3)], results=[(i, "A", 5.0, None, False, None, None) for i in (1, 2, 3)])
    row = recoveries.cal_linearity(b, {}).details.first()
    assert row["r"] == 0.0 and row["ok"] is False


def test_blank_uses_its_limit_when_censored(spark):
    b = batch(spark, [("m", "MB", None, None)] * 4, results=[(1, "A", -0.05, None, False, None, None), (2, "A", 0.1, None, False, None, None), (3, "A", None, None, True, 0.1, None), (4, "A", None, None, True, 0.2, None)])
    assert [r["ok"] for r in recoveries.method_blank(b, LOQ).details.orderBy("row_pos").collect()] == [True, False, True, None]
    with pytest.raises(ValueError):
        recoveries.method_blank(b, {"limit": "MDL"})


def test_duplicates_use_the_first_parent(spark):
    b = batch(spark, [("p", "SAMPLE", None, None), ("p", "SAMPLE", None, None), ("p-DUP", "DUP", None, "p"), ("q-DUP", "DUP", None, "q")], results=[(1, "A", 10.0, None, False, None, None), (2, "A", 99.0, None, False, None, None), (3, "A", 11.0, None, False, None, None)])
    rows = {r["row_pos"]: r for r in pairs.dup_rpd(b, LOQ).details.collect()}
    assert rows[3]["ok"] is True and abs(rows[3]["rpd_pct"] - 100 / 10.5) < 1e-9 and rows[4]["ok"] is None


def test_zero_spike_pair_blocks_the_batch(spark):
    b = batch(spark, [("p", "SAMPLE", None, None), ("a", "MS", 5.0, "p"), ("b", "MSD", 5.0, "p")], results=[(1, "A", 1.0, None, False, None, None), (2, "A", 1.0, None, False, None, None), (3, "A", -1.0, None, False, None, None)])
    assert outcomes(b, pairs.ms_msd(b, LOQ)).first()["outcome"] == "NOT_EVALUATED"


def test_lines_name_the_high_one(spark):
    b = batch(spark, [("s", "SAMPLE", None, None)] * 4, labels=("Cr 205", "Cr 267"), results=[(i, x, c, None, False, None, None) for i in range(1, 5) for x, c in (("Cr 205", 20.0), ("Cr 267", 10.0))])
    row = pairs.oes_line_agreement(b, LOQ).details.first()
    assert row["ok"] is False and row["high_line"] == "Cr 205"


def test_flags_never_asked_is_not_nothing_said(spark):
    b = batch(spark, [("s", "SAMPLE", None, None)], flags=[("b", 1, i, "A", "CPS RSD", 9.0, 5.0, "high", "x") for i in range(3)])
    check = pairs.instrument_flags(b, {"max_rows": 2})
    assert check.details.count() == 4 and outcomes(b, check).first()["outcome"] == "WARN"
    unasked = frames(spark, batches=[("b", "x", "t", "f", False, [])], samples=[("b", 1, 1, "s", "SAMPLE", None, None, None, [])])
    assert outcomes(unasked, pairs.instrument_flags(unasked, {})).first()["outcome"] == "NOT_EVALUATED"


def _scaled(factor):
    """An edit of the reported concentrations of all rows outside the calibration."""
    from exports import ANALYTES, sequence

    return lambda rows: {(n, f"{a} Conc. [ppb]"): f"{float(rows[n, a]) * factor(k):.4f}" for n, kind, _, _ in sequence() if not kind.startswith("Cal") for k, a in enumerate(ANALYTES)}


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    import csv

    from exports import ANALYTES

    folder = tmp_path_factory.mktemp("exports")
    wide_export(str(folder / "pass.csv"))
    wide_export(str(folder / "fail.csv"), violations=True)
    rows = {(r["Sample Name"], a): r[f"{a} Conc. [ppb]"] for r in csv.DictReader(open(folder / "pass.csv")) for a in ANALYTES}
    wide_export(str(folder / "double.csv"), edits=_scaled(lambda k: 2.0)(rows))
    wide_export(str(folder / "one.csv"), edits=_scaled(lambda k: 1.6 if k == 2 else 1.0)(rows))
    return folder


def test_golden_batches_together_and_alone(spark, exports):
    names = ["pass.csv", "fail.csv"]
    b = read_wide(spark, [str(exports / n) for n in names]).cached()
    assert b.samples.groupBy("batch_id").count().select("count").distinct().collect()[0][0] == 34
    results, _ = run(b)
    got = {n: {r["check_id"]: r["outcome"] for r in results.where(F.col("batch_id").endswith(n)).collect()} for n in names}
    assert sorted(got["pass.csv"].values()).count("PASS") == 18 and sorted(got["pass.csv"].values()).count("NOT_EVALUATED") == 3
    assert {k for k, v in got["fail.csv"].items() if v == "FAIL"} == {"ccv_recovery", "istd_recovery", "dup_rpd"}
    assert {r["batch_id"][-8:]: r["exit_code"] for r in verdict(results).collect()} == {"pass.csv": 0, "fail.csv": 2}
    assert len(got["pass.csv"]) == len(CATALOG) == 21


def test_scaled_quantities(spark, exports):
    b = read_wide(spark, [str(exports / "double.csv"), str(exports / "one.csv")]).cached()
    # the batches have three internal standards, so intensities are used as they are
    rows = outcomes(b, pairs.quant_crosscheck(b, {**LOQ}))
    assert {r["batch_id"].rsplit("/", 1)[1]: r["outcome"] for r in rows.collect()} == {"double.csv": "FAIL", "one.csv": "WARN"}


def test_packs(spark):
    assert all(len(load_pack(p)["checks"]) == 21 for p in ("epa6020b", "epa200_8", "facility_basic"))
    with pytest.raises(FileNotFoundError):
        load_pack("nothing")
    b = batch(spark, [("s", "SAMPLE", None, None)])
    results, _ = run(b, {"checks": {"precision_rsd": {"params": {"types": ["WRONG"]}}, "unknown_check": {}}})
    rows = results.collect()
    assert len(rows) == 1 and rows[0]["outcome"] == "NOT_EVALUATED" and "check error" in rows[0]["reason"]


def test_results_of_one_material_spread_over_tasks(spark):
    values = spark.createDataFrame([(0, "w", "ppb", "Cr", 10.0, None, "certified"), (0, "w", "ppb", "Fe", 1.0, None, "certified")], VALUES)
    patterns = spark.createDataFrame([(0, "w", "^W")], PATTERNS)
    b = batch(spark, [(f"W{i}", "SAMPLE", None, None) for i in range(60)] + [("S", "SAMPLE", None, None)], results=[(i + 1, "A", 10.0 if i % 2 else 50.0, None, False, None, None) for i in range(61)])
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        rows = recoveries.crm_recovery(b, {}, values, patterns).details.select("name", "ok", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["name"]: r["ok"] for r in rows} == {f"W{i}": i % 2 == 1 for i in range(60)} and len(rows) == 60
    assert len({r["task"] for r in rows}) > 1
