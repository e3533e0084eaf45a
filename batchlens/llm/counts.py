"""How often each hashed key occurs in the whole corpus, for all keys, in files in the shared folder.

Keys fall into 2**bits slots (several for each character of the corpus, so that few
keys share one). Tasks sort the slots that they meet and send, for each shard of the slot range, the
compressed differences; a shard's task adds them up and writes the slots that occur more
than once. A slot that isn't there occurs once at most.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm import scratch

_FLUSH = 1 << 21


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, dtype: str) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True), dtype)


class SlotCounts:
    """``of(keys)``: the number of times the slots of 64-bit keys occur (1 for those not kept)."""

    def __init__(self, path: str, bits: int, shards: int):
        self.path, self.bits, self.shards = path, bits, shards
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {"path": self.path, "bits": self.bits, "shards": self.shards, "open": {}}

    def _shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """A shard's slots and counts: mapped once, or, where the folder isn't mounted, read into memory for this call only."""
        if s in self.open:
            return self.open[s]
        raw = scratch.mapped(f"{self.path}/{s}")
        n = int(raw[:8].view("<i8")[0])
        got = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 10 * n].view("<u2")
        if scratch.mounted(self.path) and len(self.open) < 4096:
            self.open[s] = got
        return got

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        shard = _shard_of(slot, self.bits, self.shards)
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.diff(shard[order], prepend=-1))
        out = np.ones(len(keys), np.uint16)
        for a, b in zip(first, [*first[1:], len(order)]):
            own = order[a:b]
            slots, counts = self._shard(int(shard[own[0]]))
            if len(slots):
                at = np.searchsorted(slots, slot[own])
                at[at == len(slots)] = 0
                out[own] = np.where(slots[at] == slot[own], counts[at], 1)
        return out


def _shard_of(slot: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """The shard of each slot; ascending in the slots."""
    high = slot >> np.uint64(bits - 32) if bits > 32 else slot << np.uint64(32 - bits)
    return (high * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def slot_counts(keys: DataFrame, keys_of, characters: int) -> SlotCounts:
    """Count the keys that ``keys_of(batch)`` (an array of 64-bit hashes) gives for all batches of ``keys``."""
    spark = keys.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(2, 4 * characters))), 20, 44))
    shards = max(12, characters // (16 << 20))
    path = scratch.new_path(spark, "slots")

    def emit(held):
        slot = np.sort(np.concatenate(held) >> np.uint64(64 - bits))
        shard = _shard_of(slot, bits, shards)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        some, parts = shard[first], np.split(slot, first[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()), pa.array([int(x[0]) for x in parts], pa.int64()), pa.array([len(x) for x in parts], pa.int64()),
                pa.array([_packed(np.diff(x, prepend=x[:1]).astype("<u4" if bits < 33 else "<u8")) for x in parts], pa.binary()),
            ],
            ["shard", "first", "n", "steps"],
        )

    def count(batches):
        held, n = [], 0
        for batch in batches:
            held.append(keys_of(batch))
            n += len(held[-1])
            if n >= _FLUSH:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    def write(batches):
        parts = defaultdict(list)
        for batch in batches:
            for s, first, n, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "n", "steps"))):
                parts[s] += [(first, n, raw)] * (n > 0)
        for s, got in parts.items():
            if not got:
                scratch.put_bytes(f"{path}/{s}", [np.zeros(1, "<i8").tobytes()])
                continue
            slot = np.concatenate([np.cumsum(_unpacked(raw, n, "<u4" if bits < 33 else "<u8"), dtype=np.uint64) + np.uint64(first) for first, n, raw in got])
            slot.sort()
            new = np.flatnonzero(np.diff(slot, prepend=slot[:1] + np.uint64(1)))
            times = np.diff(new, append=len(slot))
            keep = times > 1
            scratch.put_bytes(f"{path}/{s}", [np.array([keep.sum()], "<i8").tobytes(), slot[new[keep]].astype("<u8").tobytes(), np.minimum(times[keep], 65535).astype("<u2").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], ["n"])

    schema = "shard int, first long, n long, steps binary"
    every = spark.range(shards).selectExpr("cast(id as int) as shard", "0L as first", "0L as n", "cast(null as binary) as steps")  # a file for each shard
    blobs = keys.mapInArrow(count, schema).union(every)
    blobs.repartition(shards, "shard").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return SlotCounts(path, bits, shards)


def characters(docs: DataFrame) -> int:
    """The number of characters of all texts."""
    return docs.agg(F.sum(F.length("text"))).first()[0] or 0
