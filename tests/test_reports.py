"""Reports of many batches, written by tasks and committed at once."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from batchlens.model import frames
from batchlens.plans.engine import run
from batchlens.sinks.report import batch_report
from batchlens.sinks.reports import MANIFEST, ReportWriter, committed, file_stem, register, report_rows, write_reports

PACK = {"checks": {"seq_structure": {"params": {"require": ["ICV"]}}, "ccv_recovery": {}}}


def many(spark, n):
    """n batches of three samples; every third one lacks its verification."""
    ids = spark.range(n).select(F.format_string("lab/run %d.csv", "id").alias("batch_id"), "id")
    empty = frames(spark)
    null = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    fill = lambda df, like, **own: df.select(*[own[c].alias(c) if c in own else F.col(c) if c in df.columns else null(c, like) for c in like.columns])
    batches = fill(ids, empty.batches, source_path=F.col("batch_id"), template_id=F.lit("t"), warnings=F.array(F.lit("<odd>")))
    analytes = fill(ids, empty.analytes, pos=F.lit(1), role=F.lit("analyte"), label=F.lit("9 Be"), mass=F.lit(9))
    kind = F.element_at(F.array(F.when(F.col("id") % 3 == 0, "SAMPLE").otherwise("ICV"), F.lit("CCV"), F.lit("SAMPLE")), F.col("row_pos"))
    rows = ids.select("batch_id", "id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("row_pos"))
    samples = fill(rows, empty.samples, seq_index=F.col("row_pos"), name=F.format_string("s%d", "row_pos"), type=kind, level=F.lit(50.0))
    results = fill(rows, empty.results, label=F.lit("9 Be"), conc=F.lit(50.0) + F.col("row_pos"), below_dl=F.lit(False))
    return empty.__class__(batches, analytes, samples, results, empty.istd, empty.flags)


def test_reports_of_many_batches(spark, tmp_path):
    b = many(spark, 60).cached()
    results, details = run(b, PACK)
    out = str(tmp_path / "out")
    write_reports(b, results, details, out)
    head, files = committed(out)
    assert (head["batches"], head["failed"], len(files)) == (60, 20, 60) and all(os.path.exists(f[:-4] + "html") for f in files)
    stem = file_stem("lab/run 7.csv")
    (own,) = [f for f in files if stem in f]
    got, alone = json.load(open(own)), batch_report(b, results, details, "lab/run 7.csv")
    assert {k: v for k, v in got.items() if k != "generated_at"} == {k: v for k, v in alone.items() if k != "generated_at"}
    assert got["verdict"] == "PASS" and got["checks"][0]["check_id"] == "ccv_recovery" and got["checks"][0]["details"][0]["recovery_pct"] == 104.0
    assert "&lt;odd&gt;" in open(own[:-4] + "html").read()

    write_reports(b, results, details, out, "append")
    assert committed(out)[0]["batches"] == 120
    few = results.where("batch_id < 'lab/run 2'")
    write_reports(type(b)(b.batches.where("batch_id < 'lab/run 2'"), b.analytes, b.samples, b.results, b.istd, b.flags), few, details, out)
    head, files = committed(out)
    assert head["batches"] == len(files) == 12 and sum(f.endswith(".json") for _, _, names in os.walk(out) for f in names) == 13  # the old ones are gone


def test_a_failing_job_leaves_what_was_there(spark, tmp_path):
    register(spark)
    b = many(spark, 6).cached()
    results, details = run(b, PACK)
    out = str(tmp_path / "out")
    write_reports(b, results, details, out)
    before = open(f"{out}/{MANIFEST}").read()
    bad = report_rows(b, results, details).withColumn("checks", F.transform("checks", lambda c: c.withField("rows", F.array(F.struct(F.lit(True).alias("ok"), F.when(F.col("batch_id").contains("3"), "no json").otherwise("{}").alias("payload"))))))
    with pytest.raises(Exception, match="JSON|Expecting"):
        bad.write.format("labreports").mode("overwrite").save(out)
    assert open(f"{out}/{MANIFEST}").read() == before and len(committed(out)[1]) == 6
    assert len(os.listdir(out)) == 2  # the manifest and the run that counts


def test_attempts_that_are_not_committed_do_not_count(tmp_path):
    row = Row(batch_id="b", source_path="b", template_id="t", instrument_family="f", warnings=[], analytes=[], types=[], checks=[])
    writer = ReportWriter(str(tmp_path / "out"), True)
    lost, won, empty = writer.write(iter([row])), writer.write(iter([row])), writer.write(iter([]))
    writer.commit([won, empty, None])
    head, files = committed(str(tmp_path / "out"))
    assert head["batches"] == 1 and len(files) == 1 and won.folder in files[0]
    assert not os.path.exists(tmp_path / "out" / lost.folder)
    other = ReportWriter(str(tmp_path / "out"), True)
    other.write(iter([row]))
    other.abort([])
    assert committed(str(tmp_path / "out"))[1] == files
    with pytest.raises(FileNotFoundError):
        committed(str(tmp_path / "nothing"))


def test_names_of_files():
    assert file_stem("file:/a/b c.csv") != file_stem("file:/a/b_c.csv") and file_stem("x" * 500).count("x") == 80
