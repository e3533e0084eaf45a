"""A folder of exports of all layouts, read at once, against the readers of single files."""

import time

from exports import wide_export
from pyspark.sql import functions as F
from test_sources import TWO_ROWS
from test_workbooks import emission_sheets, write_book

from batchlens.model import cut
from batchlens.sources.cells import read_export_cells
from batchlens.sources.detect import CANDIDATES, companion_names, read_batch
from batchlens.sources.folder import TEXTS, companions, layouts, read_folder
from batchlens.sources.tables import instrument_objections
from batchlens.sources.templates import load_template

SUMMARY = "\tblank\t\t10 ppb\t\nIsotope\tIntensity AVG\tIntensity RSD\tIntensity AVG\tIntensity RSD\n\tcps\t%\tcps\t%\nNa23(LR)\t100\t2.5\t5000\t1.5\nS32(MR)\t7\t\t70\t3\n"
SINGLE = "Data File :\tC:\\d\\{0}.dat\nAnalysis Date :\tWed, 14-Jul-2026 16:11:{1:02}\nAnalysis Type :\tSTD\nDilution Factor :\t2\nIsotope\tError\tIntensity AVG\tConcentration AVG\nNa23(LR)\t-\t100\t{1}.5\n"
HEAD = "Seq,Sample Name,Type,Level [ppb],9 Be {}\n"


def fill(folder, sets):
    """``sets`` files of each layout, and some that none fits."""
    (folder / "deep" / "er").mkdir(parents=True)
    for i in range(sets):
        wide_export(str(folder / f"wide{i}.csv"), bom=i % 2 == 0)
        (folder / "deep" / f"two{i}.CSV").write_bytes(TWO_ROWS.encode("cp1252"))
        (folder / f"summary{i}.ASC").write_text(SUMMARY)
        run = folder / "deep" / f"run{i % 2}"
        run.mkdir(exist_ok=True)
        (run / f"s{i}.asc").write_text(SINGLE.format(f"s{i}", i % 60))
        write_book(folder / "deep" / "er" / f"book{i}.xlsx", emission_sheets())
        (folder / f"run{i}_Conc.csv").write_text(HEAD.format("Conc. [ppb]") + f"1,a,Sample,,{i}\n2,b,Sample,,6\n")
        (folder / f"run{i}_Count.csv").write_text(HEAD.format("CPS") + "1,a,Sample,,500\n2,b,Sample,,600\n")
    (folder / "notes.txt").write_text("nothing of the kind\n")
    (folder / "broken.xlsx").write_bytes(b"PK no")
    (folder / "picture.png").write_bytes(b"\x89PNG")
    write_book(folder / "other.xlsx", {"Sheet1": [["a"]]})


def test_folder_of_mixed_exports(spark, tmp_path):
    fill(tmp_path, 2)
    got = read_folder(spark, str(tmp_path))
    name = lambda p: p.rsplit("/", 1)[-1]
    files = {name(r["path"]): r for r in got.files.collect()}
    readers = {n: (r["reader"], r["template"]) for n, r in files.items()}
    assert readers == {
        **{f"wide{i}.csv": ("wide", "masshunter_quant_wide") for i in range(2)}, **{f"two{i}.CSV": ("wide", "masshunter_2row") for i in range(2)},
        **{f"summary{i}.ASC": ("isotope summary", "element_ascii") for i in range(2)}, **{f"s{i}.asc": ("isotope file", "element_ascii") for i in range(2)},
        **{f"book{i}.xlsx": ("emission workbook", "agilent_oes") for i in range(2)}, **{f"run{i}_{k}.csv": ("wide", "masshunter_quant_wide") for i in range(2) for k in ("Conc", "Count")},
        "notes.txt": (None, None), "broken.xlsx": (None, None), "other.xlsx": (None, None),
    }
    assert files["broken.xlsx"]["note"].startswith("not a workbook") and files["notes.txt"]["note"] == "no layout fits" and files["wide0.csv"]["note"] is None
    assert name(files["run1_Conc.csv"]["companion"]) == "run1_Count.csv" and name(files["run1_Count.csv"]["batch_id"]) == "run1_Conc.csv"
    assert {name(files[f"s{i}.asc"]["batch_id"]) for i in range(2)} == {"run0", "run1"}
    b = got.frames
    assert b.batches.count() == 2 * 5 + 2 and b.batches.select("batch_id").distinct().count() == 12
    pair = b.results.where(F.col("batch_id").endswith("run1_Conc.csv")).orderBy("row_pos")
    assert [(r["conc"], r["intensity"]) for r in pair.collect()] == [(1.0, 500.0), (6.0, 600.0)]
    b = b.cached()
    for one in ("wide1.csv", "deep/two0.CSV"):  # the same tables as from the file alone
        alone = read_batch(spark, str(tmp_path / one)).frames
        for table in ("analytes", "samples", "results", "istd", "flags"):
            rows = lambda df: sorted(repr(r) for r in df.drop("batch_id", "source_path").collect())
            assert rows(getattr(b, table).where(F.col("batch_id").endswith("/" + one))) == rows(getattr(alone, table)), (one, table)
        assert b.batches.where(F.col("batch_id").endswith("/" + one)).first()["warnings"] == alone.batches.first()["warnings"]


def jobs(spark, run):
    group = f"g{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    counts, found = [], []
    templates = [load_template(t) for t in CANDIDATES]
    for n in (2, 40):
        (tmp_path / str(n)).mkdir()
        fill(tmp_path / str(n), n)
        cells = cut(read_export_cells(spark, str(tmp_path / str(n)), ["cp1252", "utf-8-sig"], TEXTS))
        counts.append(jobs(spark, lambda: found.append(layouts(cells, templates).where("reader is not null").count())))  # noqa: B023
    assert counts[1] <= counts[0] * 1.2 and found == [12, 240], (counts, found)


def test_companions_by_name(spark):
    names = ["a_conc.csv", "a.csv", "Count_7.csv", "Conc_7.csv", "alone.csv"]
    rows = [(f"file:/x/{n}",) for n in names] + [("file:/y/a.csv",), ("file:/z/Conc_7.csv",)]
    got = {(r["path"], r["companion"]) for r in companions(spark.createDataFrame(rows, "path string")).collect()}
    assert got == {("file:/x/a_conc.csv", "file:/x/a.csv"), ("file:/x/Count_7.csv", "file:/x/Conc_7.csv"), ("file:/x/Conc_7.csv", "file:/x/Count_7.csv")}
    assert companion_names("alone.csv") == []


def test_objections_are_cut_at_the_labels_of_their_own_batch(spark):
    blob = "9 Be: CPS RSD value = 8 is over the allowed maximum = 5 9 Be2: odd 52 Cr: Concentration value = 1 is below the calibration range"
    rows = [("one", 1, blob), ("two", 2, blob), ("none", 3, blob), ("one", 4, None), ("one", 5, ""), ("one", 6, "no label")]
    labels = [("one", "9 Be"), ("one", "9 Be2"), ("one", "52 Cr"), ("two", "52 Cr"), ("two", "52 Cr"), ("three", "9 Be")]
    got = instrument_objections(spark.createDataFrame(rows, "batch_id string, id int, blob string"), "blob", spark.createDataFrame(labels, "batch_id string, label string")).collect()
    assert sorted((r["id"], r["flag_pos"], r["analyte"], r["metric"], r["value"], r["limit"], r["direction"]) for r in got) == [
        (1, 0, "9 Be", "CPS RSD", 8.0, 5.0, "high"), (1, 1, "9 Be2", ": odd", None, None, None), (1, 2, "52 Cr", "Concentration", 1.0, None, "low"), (2, 0, "52 Cr", "Concentration", 1.0, None, "low"),
    ]


def test_objections_take_time_in_proportion(spark):
    labels = spark.createDataFrame([("b", f"{i} Xx") for i in range(1, 60)], "batch_id string, label string")

    def seconds(n):
        blob = "".join(f"{1 + i % 59} Xx: CPS RSD value = {i} is over the allowed maximum = 5 " for i in range(n))
        began = time.time()
        rows = instrument_objections(spark.createDataFrame([("b", blob)] * 4, "batch_id string, blob string"), "blob", labels)
        assert rows.agg(F.count("*"), F.sum("value")).first() == (4 * n, 4 * sum(range(n)))
        return time.time() - began

    seconds(100)
    assert seconds(20_000) < 12  # was beyond any patience when each piece cut the whole cell again


def test_folder_from_the_shell(spark, tmp_path, capsys):
    from batchlens.cli import main
    from batchlens.sinks.reports import committed

    (tmp_path / "in").mkdir()
    wide_export(str(tmp_path / "in" / "good.csv"))
    wide_export(str(tmp_path / "in" / "bad.csv"), violations=True)
    (tmp_path / "in" / "notes.txt").write_text("nothing\n")
    assert main(["folder", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 2
    head, files = committed(str(tmp_path / "out"))
    said = capsys.readouterr().out
    assert (head["batches"], head["failed"], len(files)) == (2, 1, 2) and "2 wide" in said and "read by no layout" in said
