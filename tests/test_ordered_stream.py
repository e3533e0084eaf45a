"""The cadence of a shuffled stream against the batch result."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.model import frames
from batchlens.operators.recoveries import ccv_frequency
from batchlens.streaming.ordered import PROVIDER, ordered_cadence

SCHEMA = "batch_id string, row_pos int, type string, at timestamp"
START = datetime(2026, 1, 1)


def run(spark, tmp_path, micro_batches, **options):
    """What the stream gives, each list of rows a micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = ordered_cadence(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        for i, rows in enumerate(micro_batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
            (part,) = (tmp_path / f"w{i}").glob("*.parquet")
            part.rename(folder / f"{i:03}.parquet")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(str(tmp_path / "out"))


def test_shuffled_rows_give_the_batch_result(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for b in ("x", "y", "z"):
        rows += [(b, i, rng.choice(["SAMPLE", "SAMPLE", "MB", "CCV", "ICB"]), START + timedelta(minutes=i)) for i in range(60)]
    late = sorted(rows, key=lambda r: r[3] + timedelta(minutes=rng.uniform(0, 9)))  # no row comes later than its neighbours by ten minutes
    micro = [late[i : i + 20] for i in range(0, len(late), 20)]
    end = [("w", 0, "SAMPLE", START + timedelta(days=9))]
    got = run(spark, tmp_path, [*micro, end, [("w", 1, "SAMPLE", START + timedelta(days=10))]], late="10 minutes", every_n=3)
    assert [r for r in late] != sorted(late, key=lambda r: (r[3]))
    samples = spark.createDataFrame(rows, SCHEMA)
    empty = frames(spark)
    b = empty.__class__(samples.select("batch_id").distinct(), empty.analytes, samples, empty.results, empty.istd, empty.flags)
    whole = ccv_frequency(b, {"every_n": 3}).details.where("closed").select("batch_id", "segment", "analyses", "ok")
    of = lambda df: sorted(map(tuple, df.collect()))
    assert of(got.where("kind = 'segment' and batch_id <> 'w'").select("batch_id", "segment", "analyses", "ok")) == of(whole)
    first = samples.withColumn("i", F.row_number().over(W.partitionBy("batch_id", "type").orderBy("row_pos"))).where("i = 1").select("batch_id", "type", "row_pos")
    assert of(got.where("kind = 'first seen' and batch_id <> 'w'").select("batch_id", "type", "row_pos")) == of(first)


def test_idle_batches_leave_the_state(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    micro = [[("x", 0, "SAMPLE", at(0)), ("x", 1, "CCV", at(1))], [("y", 0, "SAMPLE", at(500))], [("y", 1, "SAMPLE", at(600))], [("x", 9, "SAMPLE", at(700)), ("x", 10, "CCV", at(701))], [("y", 2, "SAMPLE", at(1500))], [("y", 3, "SAMPLE", at(1600))]]
    got = run(spark, tmp_path, micro, late="1 minute", idle="60 minutes")
    segments = sorted((r["row_pos"], r["segment"], r["analyses"]) for r in got.where("kind = 'segment' and batch_id = 'x'").collect())
    assert segments == [(1, 1, 1), (10, 1, 1)]  # the second one starts anew: the batch had been dropped
