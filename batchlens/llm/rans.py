"""Token ids as files of static range asymmetric numeral systems (rANS).

``write_tokens`` encodes every text, appends an end id, and writes all ids in
ascending order of document id. ``read_tokens`` decodes the files again.

File format: a folder with ``table`` (one shared frequency table: token, freq; the
frequencies add up to 2**BITS) and ``segments`` (Parquet; one row a segment of
whole documents). A segment's ids are cut into blocks of ``BLOCK`` ids, each coded by
``LANES`` interleaved coders into its own run of 32-bit words. ``checkpoints`` holds per
block the first word, the number of ids, and CRC-32 of the ids; ``states`` the coders' states at the
block's entry: with these any block decodes without the others. Segments of one
file, and the files by name, are in ascending order of document id.

Nulls: a null text is empty (its ids are the end id alone); null ids of documents
come first; rows that share an id stay separate rows, ordered by their ids.
Very long texts are segments of more blocks, encoded whole in one task. Columns other than doc_id and text are not
looked at, so their names can't clash. An empty table gives an empty folder of segments and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.bpe import default_tokenizer, encoder
from batchlens.llm.words import sliced

BITS = 18
LANES = 32
BLOCK = 16_384
SEGMENT = 1 << 19
_LOW = np.uint64(1 << 31)
_SEGMENTS = (
    "part int, segment int, n long, doc_ids array<long>, lengths array<int>, "
    "first_words array<int>, counts array<int>, checksums array<long>, states binary, words binary"
)


def shared_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for each id that occurs."""
    total = int(counts.sum())
    freq = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return freq
    freq[seen] = np.maximum(1, counts[seen].astype(np.float64) * (1 << BITS) / total).astype(np.int64)
    over = int(freq.sum()) - (1 << BITS)
    for i in seen[np.argsort(-freq[seen], kind="stable")]:
        if over <= 0:
            freq[i] -= over
            break
        take = min(over, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
        freq[i] -= take
        over -= take
    if freq.sum() != 1 << BITS:
        raise ValueError("more ids than the table has room for")
    return freq


class Coder:
    """Encodes and decodes whole blocks of ids against one frequency table, all lanes at once."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.pad = np.uint16(int(np.argmax(freq)))

    @staticmethod
    def _layout(n: int) -> tuple[int, int]:
        blocks = -(-n // BLOCK)
        return blocks, -(-(n - (blocks - 1) * BLOCK) // LANES) if blocks else 0

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States (blocks x lanes), the blocks' first words, and the words."""
        blocks, last = self._layout(len(ids))
        steps = BLOCK // LANES
        grid = np.full(blocks * BLOCK, self.pad, np.uint16)
        grid[: len(ids)] = ids
        grid = grid.reshape(blocks, steps, LANES)
        x = np.full((blocks, LANES), _LOW, np.uint64)
        out: list[list[np.ndarray]] = []
        for t in range(steps - 1, -1, -1):
            b = blocks if t < last else blocks - 1
            if not b:
                continue
            s, y = grid[:b, t], x[:b]
            f = self.freq[s]
            full = y >= f << np.uint64(63 - BITS)
            out.append((full, (y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
            y[full] >>= np.uint64(32)
            q = y // f
            x[:b] = (q << np.uint64(BITS)) + (y - q * f) + self.start[s]
        each = [np.flatnonzero(full) // LANES for full, _ in reversed(out)]
        block = np.concatenate(each) if each else np.zeros(0, np.int64)
        words = np.concatenate([w for _, w in reversed(out)]) if out else np.zeros(0, np.uint32)
        order = np.argsort(block, kind="stable")
        first = np.searchsorted(block[order], np.arange(blocks))
        return x, first.astype(np.int32), words[order]

    def decode(self, n: int, states: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The ``n`` ids of consecutive blocks, of which the last alone may be short."""
        blocks, last = self._layout(n)
        steps = BLOCK // LANES
        x = states.reshape(blocks, LANES).copy()
        at = first.astype(np.int64)
        grid = np.empty((blocks, steps, LANES), np.uint16)
        mask = np.uint64((1 << BITS) - 1)
        words = np.concatenate([words, np.zeros(1, np.uint32)])
        for t in range(steps):
            b = blocks if t < last else blocks - 1
            if not b:
                break
            slot = x[:b] & mask
            s = self.symbol[slot]
            grid[:b, t] = s
            y = self.freq[s] * (x[:b] >> np.uint64(BITS)) + slot - self.start[s]
            need = y < _LOW
            run = np.cumsum(need, axis=1)
            take = (at[:b, None] + run - 1)[need]
            y[need] = (y[need] << np.uint64(32)) | words[take]
            at[:b] += run[:, -1]
            x[:b] = y
        return grid.reshape(-1)[:n]


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, ids (16-bit little-endian, with the end id) of every row of ``docs``.

    A last row of each task has no ids but ``counts``: how often each of its ids occurs.
    """
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u2").tobytes()
    names = ["doc_id", "ids", "counts"]

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in sliced(batches, "text", 1 << 20):
            ids = [x + end for x in encoder(path).ids(batch.column("text").to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << 16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def _counted(ids: DataFrame) -> np.ndarray:
    """How often each id occurs: one bounded row (65,536 counters at most) for each id that occurs."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["token", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in ids.where("counts is not null").select("counts").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode the column ``text`` of ``docs`` and write all ids in ascending ``doc_id`` to the folder ``path``."""
    spark = docs.sparkSession
    ids = scratch.saved(encoded(docs, tokenizer, end_id), "token-ids")
    freq = shared_table(_counted(ids))
    token = np.flatnonzero(freq)
    table = [(int(t), int(freq[t])) for t in token]
    spark.createDataFrame(table, "token int, freq int").coalesce(1).write.parquet(f"{path}/table")

    def run(batches):
        coder, part, segment = Coder(freq), TaskContext.get().partitionId(), 0
        docs_of, held, n = [], [], 0

        def row():
            flat = np.frombuffer(b"".join(held), "<u2")
            states, first, words = coder.encode(flat)
            cuts = range(0, len(flat), BLOCK)
            values = [
                part, segment, len(flat), docs_of, [len(x) // 2 for x in held], first.tolist(),
                [min(BLOCK, len(flat) - c) for c in cuts], [zlib.crc32(flat[c : c + BLOCK].tobytes()) for c in cuts],
                states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "segment", "n", "doc_ids", "lengths", "first_words", "counts", "checksums", "states", "words"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs_of.append(d)
                held.append(x)
                n += len(x) // 2
                if n >= SEGMENT:
                    yield row()
                    docs_of, held, n, segment = [], [], 0, segment + 1
        if held:
            yield row()

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.where("counts is null").select("doc_id", "ids").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, _SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (16-bit little-endian) from the files.

    A block whose checksum differs raises an error.
    """
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.schema("token int, freq int").parquet(f"{path}/table").collect():
        freq[r["token"]] = r["freq"]
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    files = segments.groupBy("part").agg(F.sum("n").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = segments.select("part", "segment", "n")
    inner = inner.withColumn("inner", F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n"))
    starts = inner.join(files, "part").select("part", "segment", (F.col("inner") + F.col("before")).alias("first"))

    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for k in range(len(batch)):
                get = lambda c: batch.column(c)[k]
                n, lengths = get("n").as_py(), np.array(get("lengths").as_py(), np.int64)
                ids = coder.decode(
                    n, np.frombuffer(get("states").as_buffer(), "<u8"), np.array(get("first_words").as_py(), np.int64),
                    np.frombuffer(get("words").as_buffer(), "<u4"),
                )
                for c, crc in zip(range(0, n, BLOCK), get("checksums").as_py()):
                    if zlib.crc32(ids[c : c + BLOCK].tobytes()) != crc:
                        raise ValueError(f"damaged block in file {get('part')}, segment {get('segment')}")
                ends = np.cumsum(lengths)
                raw = ids.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([get("part").as_py()] * len(ends), pa.int32()), pa.array([get("segment").as_py()] * len(ends), pa.int32()),
                        batch.column("doc_ids")[k].values, pa.array(ends - lengths), pa.array(lengths),
                        pa.array([raw[2 * (e - m) : 2 * e] for e, m in zip(ends.tolist(), lengths.tolist())], pa.binary()),
                    ],
                    ["part", "segment", "doc_id", "at", "n_tokens", "ids"],
                )

    schema = "part int, segment int, doc_id long, at long, n_tokens long, ids binary"
    small = F.broadcast(starts) if _few(spark, segments) else starts
    out = segments.drop("counts").mapInArrow(run, schema).join(small, ["part", "segment"])
    return out.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def _few(spark: SparkSession, segments: DataFrame) -> bool:
    return segments.count() <= 200_000


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "rans")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digests(read_tokens(spark, path))
