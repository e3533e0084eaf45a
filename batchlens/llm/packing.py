"""Best-fit packing of token sequences, by hierarchical residual packing.

Each partition packs its own pieces best-fit decreasing. Nearly full bins are final at
once. Underfull bins go on as items: groups of partitions merge, and each
merged task packs those bins best-fit again, level by level, until one task has seen the
rest or a level joins no more bins. A task holds at most ``PER_TASK`` bins after the first level,
so no level gathers an unbounded number, and a task packs at most ``HELD`` rows (and a batch) together.

Nulls: a null text is its end id alone. Rows with the same or a null ``doc_id`` stay
separate documents, so that (doc_id, piece) is as unique as doc_id is. An empty table
gives no rows. Documents longer than a sequence are cut, however long; the first piece takes the remainder.
Other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.bpe import MOST, default_tokenizer, encoder
from batchlens.llm.words import sliced

PER_TASK = 16_384
FAN_IN = 4
#: Rows that a task holds before it packs them.
HELD = 65_536
_ITEM = np.dtype([("key", "<i8"), ("length", "<i4")])


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: the indices of ``sizes`` in each bin of ``room``.

    Bins are kept by what is left in them, and one integer has a bit set for each
    remainder that some bin has, so that the tightest bin is found by its lowest set bit.
    """
    bins: list[list[int]] = []
    by_left: list[list[int]] = [[] for _ in range(room + 1)]
    left_bits = 0
    for i, size in sorted(enumerate(sizes.tolist()), key=lambda x: -x[1]):
        fits = left_bits >> size
        if fits:
            left = (fits & -fits).bit_length() - 1 + size
            b = by_left[left].pop()
            if not by_left[left]:
                left_bits ^= 1 << left
            bins[b].append(i)
        else:
            left, b = room, len(bins)
            bins.append([i])
        left -= size
        if left:
            by_left[left].append(b)
            left_bits |= 1 << left
    return bins


def token_pieces(docs: DataFrame, size: int, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, remembered: int = MOST) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of all documents, cut to ``size`` ids at most."""
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u2").tobytes()

    def run(batches):
        for batch in sliced(batches, "text", 1 << 20):
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for r, ids in enumerate(encoder(path, remembered).ids(batch.column("text").to_pylist())):
                ids = np.frombuffer(ids + end, "<u2")
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                    parts.append(ids[a:b].tobytes() if with_ids else None)
            arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(parts, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _packed(rows: DataFrame, size: int, slack: int) -> DataFrame:
    """The bins of each partition of ``rows`` (fill, items), packed ``HELD`` rows at a time."""

    def packed(fill, items):
        fill = np.concatenate(fill)
        bins = best_fit(fill, size)
        for i in range(0, len(bins), 4096):
            some = bins[i : i + 4096]
            total = [int(fill[b].sum()) for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(total, pa.int32()), pa.array([b"".join(items[k] for k in b) for b in some], pa.binary()), pa.array([t >= size - slack for t in total])],
                ["fill", "items", "done"],
            )

    def run(batches):
        fill, items = [], []
        for batch in batches:
            fill.append(batch.column("fill").to_numpy())
            items += batch.column("items").to_pylist()
            if len(items) >= HELD:
                yield from packed(fill, items)
                fill, items = [], []
        if items:
            yield from packed(fill, items)

    return rows.select("fill", "items").mapInArrow(run, "fill int, items binary, done boolean")


def sequences(pieces: DataFrame, size: int, slack: int = 4) -> DataFrame:
    """key, sequence_id, offset for the rows (key long, length) of ``pieces``; lengths are 1 to ``size``."""

    def first(batches):
        for batch in batches:
            items = np.empty(len(batch), _ITEM)
            items["key"], items["length"] = batch.column("key").to_numpy(), batch.column("length").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(items["length"]), pa.array([x.tobytes() for x in items], pa.binary())], ["fill", "items"])

    rows = pieces.select("key", F.col("length").cast("int").alias("length")).mapInArrow(first, "fill int, items binary")
    tasks = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    bins = scratch.saved(_packed(rows, size, slack), "bins")
    final, before = [], None
    while True:
        final.append(bins.where("done"))
        rest = bins.where("not done")
        count = rest.count()
        if not count:
            break
        if before is not None and (tasks == 1 or count > 0.98 * before and tasks <= -(-count // PER_TASK)):
            final.append(rest)
            break
        before, tasks = count, max(-(-tasks // FAN_IN), -(-count // PER_TASK))
        bins = scratch.saved(_packed(rest.repartition(tasks), size, slack), "bins")

    def places(batches):
        for batch in batches:
            got = [np.frombuffer(x.as_buffer(), _ITEM) for x in batch.column("items")]
            key = np.concatenate([x["key"] for x in got])
            offset = np.concatenate([np.cumsum(x["length"]) - x["length"] for x in got])
            seq = np.repeat(batch.column("sequence_id").to_numpy(), [len(x) for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seq), pa.array(offset.astype(np.int64))], ["key", "sequence_id", "offset"])

    every = final[0].select("items")
    for x in final[1:]:
        every = every.union(x.select("items"))
    return every.withColumn("sequence_id", F.monotonically_increasing_id()).mapInArrow(places, "key long, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, remembered: int = MOST) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and offset; ``with_ids`` adds its ids; a worker remembers about ``remembered`` pieces of text."""
    pieces = token_pieces(docs, size, tokenizer, end_id, with_ids, remembered).withColumn("key", F.monotonically_increasing_id())
    pieces = scratch.saved(pieces, "pieces")
    return pieces.join(sequences(pieces, size), "key").drop("key")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
