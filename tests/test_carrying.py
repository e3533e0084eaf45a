"""Outcomes from samples that carry their results against those of each check's own joins, and how much they move."""

import os

import pytest
from test_fused import STRICT, batches, params  # noqa: F401  batches is a fixture

from batchlens.model import carries, frames
from batchlens.plans.engine import CATALOG, folded
from batchlens.plans.fused import all_outcomes
from batchlens.queries import QUERIES

KINDS = ["CAL_STD", "CAL_STD", "CAL_STD", "CAL_BLANK", "ICV", "CCB", "MB", "SAMPLE", "DUP", "MS", "MSD", "SERIAL_DIL", "CCV"]


def odd(spark):
    """Names and parents that are null, repeated and missing, results of no analyte and of no sample, samples without results."""
    out = {k: [] for k in ("batches", "analytes", "samples", "results", "istd", "flags")}
    for n, batch in enumerate("abcd"):
        out["batches"].append((batch, "x", "t", "f", batch != "d", []))
        for pos, label in enumerate(["L1", "L2", "L3"]):
            out["analytes"].append((batch, pos, "analyte", label, None, "Xx" if label != "L3" else "Yy", None, None, 100.0 * (pos + 1)))
        for k in range(n % 3):
            out["analytes"].append((batch, 8 + k, "istd", f"IS{k}", None, None, None, None, None))
        kinds = [x for i, x in enumerate(KINDS * 4) if n != 2 or i % 13 not in (4, 9)]
        for i, kind in enumerate(kinds):
            name = None if i == 7 else "twice" if kind == "SAMPLE" and i > 30 else "CRM-EXAMPLE-1" if i == 20 else f"S{i}"
            parent = {"DUP": f"S{i - 1}", "MS": "twice", "MSD": "twice", "SERIAL_DIL": "nobody" if i > 30 else f"S{i - 4}"}.get(kind) if i != 8 else None
            level = 5.0 * (1 + i % 7) if kind in ("CAL_STD", "ICV", "CCV") else 20.0 if kind in ("MS", "MSD") else None
            out["samples"].append((batch, i, i, name, kind, level, parent, None, ["said"] if n == 1 and i % 9 == 4 else None))
            for j, label in enumerate(["L1", "L2", "L3", "other"]):
                if (i + j) % 5 == 4 or i == 9:
                    continue
                conc = (level or 3.0 + i) * (1 + 0.01 * ((i * 7 + j * 3 + n) % 11)) if (i * j) % 6 != 5 else None
                out["results"].append((batch, i, label, conc, "ppb", conc and conc * 2000 * (2 if n == 3 else 1), conc is None, 0.05 if conc is None else None, float((i + j) % 9) if n != 2 else None))
                if (i + j + n) % 8 == 3:
                    out["flags"].append((batch, i, j, label, "CPS RSD", 9.0, 7.0, "high", "t"))
            for k in range(n % 3):
                out["istd"].append((batch, i, f"IS{k}", None if (i + k) % 10 == 9 else 1000.0 + 100 * ((i * 3 + k) % 8)))
        out["results"].append((batch, 999, "L1", 1.0, "ppb", 2000.0, False, None, None))
    return frames(spark, **out)


def outcomes_of(df):
    return {(r["batch_id"], r["check_id"]): (r["outcome"], r["reason"]) for r in df.collect()}


@pytest.mark.parametrize("own", [{}, STRICT])
def test_carrying_samples_give_the_outcomes_of_each_check(spark, batches, own):  # noqa: F811
    p = params(**own)
    b = batches.carrying()
    assert carries(b.samples) and not carries(batches.samples)
    expected = outcomes_of(folded(batches, {c: CATALOG[c](batches, v) for c, v in p.items()}))
    assert outcomes_of(all_outcomes(b, p)) == expected and len(expected) == 4 * 21


def test_odd_names_parents_and_results(spark, monkeypatch):
    p = {c: {"loq_ppb": {"default": 0.1}} for c in CATALOG} | {"seq_structure": {"require": ["ICV", "LCS"]}, "quant_crosscheck": {"min_cal_r": 0.2, "max_deviation_pct": 2, "min_shared_analytes": 2}}
    b = odd(spark)
    expected = outcomes_of(folded(b, {c: CATALOG[c](b, v) for c, v in p.items()}))
    assert outcomes_of(all_outcomes(b.carrying(), p)) == expected
    assert len({o for o, _ in expected.values()}) == 4
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    b = b.carrying()
    assert b.samples.is_cached and outcomes_of(all_outcomes(b, p)) == expected


def moved(spark):
    """Bytes that stages have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def on_disk(folder):
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, names in os.walk(folder) for f in names)


def test_every_outcome_moves_and_keeps_little(spark):
    sf = "/root/testdata/sf0.01"
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before, held = moved(spark), on_disk(shared)
    assert QUERIES["every_outcome"](spark, sf).count() == 1890
    shuffled = sum(v for k, v in moved(spark).items() if k not in before)
    read = sum(os.path.getsize(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    assert shuffled + on_disk(shared) - held < 4 * read, (shuffled, on_disk(shared) - held, read)
