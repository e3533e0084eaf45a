"""Every query against its SQL in DuckDB at the smallest size."""

import math
from decimal import Decimal

import duckdb
import pytest

from batchlens.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def normal(v):
    if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
        return v
    return None if math.isnan(v) else round(float(v), 9) + 0.0


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected, got = con.execute(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    names = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, expected.fetchall())


@pytest.mark.parametrize("name", ["precision_rsd", "every_outcome"])
def test_a_batch_without_any_line(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when o_orderkey < 3 then 900001 else o_custkey end as o_custkey) from '{SF}/orders.parquet' where o_orderkey < 60) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select * from '{SF}/lineitem.parquet' where l_orderkey between 3 and 59) to '{tmp_path}/lineitem.parquet'")
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    expected, got = con.execute(ORACLE_SQL[name]), QUERIES[name](spark, str(tmp_path))
    names = [c[0] for c in expected.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_streamed_cadence(spark, tmp_path):
    from batchlens.streaming.cadence import streamed_cadence

    rows = [("b", i, t) for i, t in enumerate(["SAMPLE"] * 3 + ["CCV", "SAMPLE", "CCV"])]
    spark.createDataFrame(rows, "batch_id string, row_pos int, type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("batch_id string, row_pos int, type string").parquet(str(tmp_path / "in"))
    q = streamed_cadence(stream, 2).writeStream.format("memory").queryName("cadence").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["segment"], r["analyses"], r["ok"]) for r in spark.table("cadence").orderBy("segment").collect()]
    assert got == [(1, 3, False), (2, 1, True)]


def test_entry_points_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 33"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True).returncode == 0
