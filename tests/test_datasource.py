"""Exports as data sources: batches, bounded memory, and a growing folder as a stream."""

import os
import time
import tracemalloc

import pytest
from exports import wide_export
from pyspark.sql import functions as F
from test_sources import TWO_ROWS

from batchlens.sources import datasource
from batchlens.sources.cells import read_cells
from batchlens.sources.templates import load_template
from batchlens.sources.wide import columns


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def cells_of(df):
    return sorted((r["path"].rsplit("/", 1)[-1], r["row"], r["col"], r["value"]) for r in df.select("path", "row", "col", "value").collect())


def test_cells_equal_those_of_the_other_reader(source, tmp_path):
    wide_export(str(tmp_path / "a.csv"), bom=True)
    (tmp_path / "b.csv").write_text('x,"two\nlines",é\n,,\n1\n', encoding="utf-8")
    (tmp_path / "c.asc").write_text("a\tb,c\td\n1\t2\n")
    (tmp_path / "_hidden.csv").write_text("x")
    (tmp_path / "empty.csv").write_text("")
    for most in (1, 10**9):  # a task for each file, one task for all
        got = source.read.format("labcells").option("partitionBytes", most).option("batchRows", 7).load(str(tmp_path))
        assert got.rdd.getNumPartitions() == (3 if most == 1 else 1) + (most == 1) and got.schema.simpleString() == "struct<path:string,row:int,col:int,value:string>"
        expected = cells_of(read_cells(source, [str(tmp_path / n) for n in ("a.csv", "b.csv")])) + cells_of(read_cells(source, str(tmp_path / "c.asc"), delimiter="\t"))
        assert cells_of(got) == sorted(expected)
    only = source.read.format("labcells").load(f"file://{tmp_path}/b*.csv")
    assert only.count() == 7 and {r["path"] for r in only.select("path").collect()} == {f"file://{tmp_path}/b.csv"}
    with pytest.raises(Exception, match="nowhere"):
        source.read.format("labcells").load(str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("template", ["masshunter_quant_wide", "masshunter_2row"])
def test_wide_cells_know_their_columns(source, tmp_path, template):
    path = tmp_path / "x.csv"
    if template == "masshunter_2row":
        path.write_bytes(TWO_ROWS.encode("cp1252"))
    else:
        wide_export(str(path))
    got = source.read.format("labwide").option("template", template).load(str(path))
    t = load_template(template)
    cells = read_cells(source, str(path), t.encoding)
    cols = columns(cells, t).where("kind not in ('unmapped', 'ignored')")
    expected = cells.where(F.col("row") >= t.header_rows).join(cols, ["path", "col"]).select("row", "col", "name", "kind", "label", "unit", "value")
    rows = lambda df: sorted(map(repr, df.select("row", "col", "name", "kind", "label", "unit", "value").collect()))
    assert rows(got) == rows(expected) and got.where("kind = 'conc'").count() > 0


def test_a_large_file_is_never_held_whole(tmp_path):
    path = tmp_path / "big.csv"
    with open(path, "w") as f:
        for i in range(300_000):
            f.write(f"{i},some value of a cell,{i / 7}\n")
    reader = datasource._BatchReader({"path": str(path), "batchrows": "5000"}, False)
    (part,) = reader.partitions()
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 900_000 and peak < 8 << 20 < path.stat().st_size


def test_stream_of_a_growing_folder(source, tmp_path):
    folder, done = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()

    def put(name, text, age):
        (folder / name).write_text(text)
        os.utime(folder / name, (time.time() - age,) * 2)

    def run():
        stream = source.readStream.format("labcells").option("filesPerBatch", 2).option("settle", 5).load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", done).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["path"].rsplit("/", 1)[-1], r["value"]) for r in source.read.parquet(str(tmp_path / "out")).collect())

    put("b.csv", "1", 100)
    put("a.csv", "2", 90)
    put("c.csv", "3", 90)
    put("half.csv", "not yet", 0)
    assert run() == [("a.csv", "2"), ("b.csv", "1"), ("c.csv", "3")]
    put("d.csv", "4", 80)
    put("half.csv", "now", 70)
    assert run() == [("a.csv", "2"), ("b.csv", "1"), ("c.csv", "3"), ("d.csv", "4"), ("half.csv", "now")]  # a new query goes on from the offsets
    assert run() == run()
