"""Readers of export layouts, detection, reports, and the profile of an unknown layout."""

import json

import pytest
from exports import ANALYTES, wide_export
from pyspark.sql import functions as F

from batchlens.model import cut
from batchlens.plans.engine import run
from batchlens.plans.packs import resolve
from batchlens.sinks.report import as_html, batch_report, write_report
from batchlens.sinks.review import accepted, review, validation
from batchlens.sources import profile
from batchlens.sources.cells import decoded, read_cells
from batchlens.sources.crm import load_library
from batchlens.sources.detect import companion, read_batch
from batchlens.sources.templates import classify, load_template, template_of
from batchlens.sources.transposed import emission_frames, looks_like_emission_workbook, read_isotope_folder, read_isotope_summary
from batchlens.sources.wide import read_wide, read_wide_results


def test_wide_export(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    wide_export(path, bom=True, edits={("S001", "9 Be Conc. [ppb]"): "<0.05", ("S002", "9 Be Conc. [ppb]"): "", ("S004", "Type"): "PrepBlank"})
    b = read_wide(spark, path)
    assert [r["label"] for r in b.analytes.where("role = 'analyte'").orderBy("pos").collect()] == ANALYTES
    assert b.analytes.where("role = 'istd'").count() == 3 and b.analytes.where("element = 'As' and mass = 75 and mode = 'He'").count() == 1
    head = b.batches.first()
    assert head["warnings"] == ["unrecognised sample type: PrepBlank"] and not head["flags_column_mapped"]
    r = b.results.join(b.samples, ["batch_id", "row_pos"]).where("label = '9 Be'")
    one, two = (r.where(f"name = '{n}'").first() for n in ("S001", "S002"))
    assert (one["conc"], one["below_dl"], one["dl"]) == (None, True, 0.05) and (two["conc"], two["below_dl"]) == (None, False)
    assert b.samples.where("name = 'S003-DUP'").first()["parent_name"] == "S003"
    with pytest.raises(ValueError):
        read_wide(spark, path, "masshunter_2row")


TWO_ROWS = """Sample,,,,,56  Fe  [ He ],,115  In ( ISTD )  [ No Gas ],
,Rjct,Type,Level,Sample Name,Conc. [ ppb ],Conc. RSD,CPS,CPS RSD
,,CalStd,1,10ppb STD,10.1,1.5,5000,0.5
56  Fe  [ He ]: CPS RSD value = 12.10 is over the allowed maximum = 5.00,,QC1,1,10ppb µ,9.0,12.1,5100,0.4
,,,,,,,,
"""


def test_two_header_rows(spark, tmp_path):
    path = tmp_path / "two.csv"
    path.write_bytes(TWO_ROWS.encode("cp1252"))
    d = read_batch(spark, str(path))
    b = d.frames
    assert d.template == "masshunter_2row"
    assert [(r["name"], r["type"], r["level"]) for r in b.samples.orderBy("row_pos").collect()] == [("10ppb STD", "CAL_STD", 10.0), ("10ppb µ", "CCV", 10.0)]
    assert b.results.where("conc = 10.1 and rsd_pct = 1.5").count() == 1 and b.istd.count() == 2
    flag = b.flags.first()
    assert (flag["analyte"], flag["metric"], flag["value"], flag["limit"], flag["direction"]) == ("56  Fe  [ He ]", "CPS RSD", 12.1, 5.0, "high")


def test_decoding():
    assert decoded("é".encode("utf-8-sig"), "cp1252") == ("é", None)
    text, note = decoded("é".encode("cp1252"), "utf-8")
    assert text == "é" and "cp1252" in note


def test_companion_counts(spark, tmp_path):
    head = "Seq,Sample Name,Type,Level [ppb],9 Be {}\n"
    (tmp_path / "run_Conc.csv").write_text(head.format("Conc. [ppb]") + "1,a,Sample,,5\n2,b,Sample,,6\n")
    (tmp_path / "run_Count.csv").write_text(head.format("CPS") + "1,a,Sample,,500\n2,b,Sample,,600\n")
    assert companion(str(tmp_path / "run_Conc.csv")) == str(tmp_path / "run_Count.csv")
    d = read_batch(spark, str(tmp_path / "run_Conc.csv"))
    assert d.companion and [(r["conc"], r["intensity"]) for r in d.frames.results.orderBy("row_pos").collect()] == [(5.0, 500.0), (6.0, 600.0)]


def test_isotope_summary(spark, tmp_path):
    path = tmp_path / "s.ASC"
    path.write_text("\tblank\t\t10 ppb\t\nIsotope\tIntensity AVG\tIntensity RSD\tIntensity AVG\tIntensity RSD\n\tcps\t%\tcps\t%\nNa23(LR)\t100\t2.5\t5000\t1.5\nS32(MR)\t7\t\t70\t3\n")
    b = read_isotope_summary(spark, str(path))
    assert [(r["name"], r["type"], r["level"]) for r in b.samples.orderBy("row_pos").collect()] == [("blank", "CAL_BLANK", None), ("10 ppb", "CAL_STD", 10.0)]
    assert b.results.where("label = 'Na23(LR)' and intensity = 5000 and rsd_pct = 1.5").count() == 1 and b.analytes.where("mode = 'MR' and mass = 32").count() == 1


def test_isotope_folder(spark, tmp_path):
    for name, day in (("z", "14"), ("a", "15")):
        (tmp_path / f"{name}.txt").write_text(f"Data File :\tC:\\d\\{name}.dat\nAnalysis Date :\tWed, {day}-Jul-2026 16:11:40\nAnalysis Type :\tSTD\nDilution Factor :\t2\nIsotope\tError\tIntensity AVG\tConcentration AVG\nNa23(LR)\t-\t100\t1.5\n")
    b = read_isotope_folder(spark, str(tmp_path))
    assert [(r["name"], r["type"], r["dilution_factor"]) for r in b.samples.orderBy("row_pos").collect()] == [("z", "CAL_STD", 2.0), ("a", "CAL_STD", 2.0)]
    assert b.results.where("conc = 1.5 and intensity = 100").count() == 2 and b.batches.count() == 1


def test_emission_workbook_cells(spark):
    rows = []
    for sheet, unit, values in (("Conc. in Sample Units", "mg/L", ("1.5", "2.5")), ("Corrected Intensities", "cps", ("150", "250"))):
        lines = [["", "Sample Id", f"U 385.958\n({unit})", f"U 367.007\n({unit})"], ["1", "HNO3 blank", *values], ["2", "100 ppb U", *values]]
        rows += [("w", sheet, r, c, v) for r, line in enumerate(lines) for c, v in enumerate(line)]
    b = emission_frames(spark.createDataFrame(rows, "path string, sheet string, row int, col int, value string"), load_template("agilent_oes"))
    assert [(r["name"], r["type"]) for r in b.samples.orderBy("row_pos").collect()] == [("HNO3 blank", "CAL_BLANK"), ("100 ppb U", "CAL_STD")]
    assert b.results.where("label = 'U 385.958' and conc = 1.5 and unit = 'mg/L' and intensity = 150").count() == 2
    assert b.analytes.where("element = 'U'").count() == 2


def test_templates():
    assert load_template("masshunter_counts_2row").id == "masshunter_2row"
    with pytest.raises(ValueError):
        template_of({"id": "x"})
    with pytest.raises(ValueError):
        template_of({"id": "x", "analyte_cps_pattern": "a", "sample_type_vocab": {"L": "LCSD"}})


def test_library(tmp_path):
    values, patterns, unfilled = load_library("crm")
    assert len(values) == 8 and len(patterns) == 1 and unfilled[0][1] == []
    (tmp_path / "x.yaml").write_text("id: x\n")
    with pytest.raises(ValueError):
        load_library(str(tmp_path))


def test_report_and_profile(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    wide_export(path, violations=True)
    b = read_wide(spark, path).cached()
    results, details = run(b, {"checks": {"ccv_recovery": {}, "seq_structure": {"params": {"require": ["ICV"]}}}})
    report = batch_report(b, results, details, b.batches.first()["batch_id"])
    assert report["verdict"] == "FAIL" and [c["check_id"] for c in report["checks"]] == ["ccv_recovery", "seq_structure"]
    _, data = write_report(report, str(tmp_path / "out"))
    assert json.loads(data.read_text())["batch"]["n_samples"] == 34 and "ccv_recovery" in as_html(report)
    print_ = profile.fingerprint(read_cells(spark, path))
    kinds = {c["name"]: c["kind"] for c in print_["columns"]}
    assert kinds["Seq"] == "numeric" and kinds["Type"] == "categorical" and not print_["sub_header"]


def test_redaction(spark):
    cells = {"9 Be Conc. [ppb]": True, "Northside Well 3": False, "methodblank": True, "CalStd 5": True, "In-Situ Inc": False, "QC1": True, "Am 5": False, "Md 21201": False, "1.5e3": True, "": True, "10ppb STD": True}
    rows = spark.createDataFrame([(t,) for t in cells], "t string")
    got = {r["t"]: r["r"] for r in rows.select("t", profile.redacted(F.col("t"), F.lit(True)).alias("r")).collect()}
    assert {t: got[t] == t for t in cells} == cells and got["In-Situ Inc"] == "██-████ ███" and got["Northside Well 3"].endswith(" 3")
    hidden = rows.where("t = 'CalStd 5'").select(profile.redacted(F.col("t"), F.lit(False))).first()[0]
    assert hidden == "CalStd █" and spark.createDataFrame([(None,)], "t string").select(profile.redacted(F.col("t"))).first()[0] is None
    long = spark.createDataFrame([(1, "x" * 50_000 + " blank" * 9000)], "doc_id long, text string")
    shown = profile.redacted_column(long, "doc_id", "text").first()["redacted"]
    assert shown.startswith("██████ blank blank") and len(shown) == 162


def test_companion_of_either_kind(tmp_path):
    for name in ("a_conc.csv", "a.csv", "Count_7.csv", "Conc_7.csv", "alone.csv"):
        (tmp_path / name).write_text("x")
    pairs = {"a_conc.csv": "a.csv", "Count_7.csv": "Conc_7.csv", "Conc_7.csv": "Count_7.csv"}
    assert {n: companion(str(tmp_path / n)) for n in pairs} == {n: str(tmp_path / o) for n, o in pairs.items()} and companion(str(tmp_path / "alone.csv")) is None


def test_isotope_files_are_told_apart_and_others_refused(spark, tmp_path):
    (tmp_path / "one.asc").write_text("Data File :\t\tC:\\d\\one.dat\nSample Name :\t\t10 ppb\nIsotope\tIntensity AVG\nNa23(LR)\t100\n")
    d = read_batch(spark, str(tmp_path / "one.asc"))
    assert d.reader == "isotope file" and [(r["name"], r["type"]) for r in d.frames.samples.collect()] == [("10 ppb", "CAL_STD")]
    (tmp_path / "other.asc").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="not an isotope table"):
        read_batch(spark, str(tmp_path / "other.asc"))
    assert not looks_like_emission_workbook(spark.createDataFrame([("w", "Sheet1", 0, 0, "x")], "path string, sheet string, row int, col int, value string"))


def test_templates_in_words():
    t = load_template("masshunter_2row")
    kinds = {n: (k, label, unit) for n, k, label, unit in classify(t, ["56  Fe  [ He ]  :: Conc. [ ppb ]", "9 Be :: Conc. RSD", "9 Be :: CPS", "Rjct", "115  In ( ISTD ) :: CPS", "Odd", "x RSD"])}
    assert list(kinds.values()) == [("conc", "56  Fe  [ He ]", "ppb"), ("rsd", "9 Be", None), ("cps", "9 Be", None), ("ignored", None, None), ("istd", "115  In ( ISTD )", None), ("unmapped", None, None), ("ignored", None, None)]
    own = template_of({"id": "x", "analyte_cps_pattern": "^(?P<label>.+) counts$"})
    assert classify(own, ["Be counts"]) == [("Be counts", "cps", "Be", None)]


def test_review_and_accept(spark, tmp_path):
    path, template = tmp_path / "x.csv", tmp_path / "t.yaml"
    wide_export(str(path), edits={("S004", "Type"): "PrepBlank"}, rename={"9 Be CPS": "9 Be Intensity"})
    template.write_text(resolve("masshunter_quant_wide", "template").read_text())
    found = validation(spark, str(template), str(path))
    text = review(found)
    assert found["analytes"] == ANALYTES and "! unmapped column ignored: 9 Be Intensity" in text and "PrepBlank" in text and "no known type" in text
    assert "FileNotFoundError" in review(validation(spark, "nothing", str(path)))
    saved = accepted(template.read_text(), "mine", str(tmp_path))
    assert saved.name == "mine.template.yaml" and load_template(str(saved)).id == "mine"


def test_results_of_a_line_stay_with_it(spark, tmp_path):
    edits = {("S001", "9 Be Conc. [ppb]"): "<0.05", ("S002", "9 Be Conc. [ppb]"): "", ("S003", "Type"): "", ("S004", "Type"): "PrepBlank"}
    wide_export(str(tmp_path / "a.csv"), edits=edits)
    wide_export(str(tmp_path / "b.csv"), bom=True)
    with open(tmp_path / "a.csv", "a") as out:
        out.write("\n,,\n ,\nshort\n")  # an empty line, blank ones, and one that ends before its type
    b = read_wide(spark, str(tmp_path / "*.csv"))
    got = read_wide_results(spark, str(tmp_path / "*.csv"))
    joined = b.samples.select("batch_id", "row_pos", "name", "type", "level").join(b.results, ["batch_id", "row_pos"]).select(got.columns)
    assert got.count() == joined.count() > 0 and got.exceptAll(joined).count() == 0
    assert b.batches.where("array_contains(warnings, '1 empty row(s) dropped')").count() == 1


def test_tables_between_stages_are_small(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    kept = cut(spark.range(20_000).selectExpr("repeat('folder/', 30) as path", "cast(id % 7 as string) as value"))
    assert kept.count() == 20_000 and size() - before < 500_000
