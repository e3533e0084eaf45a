"""Quality scores by nearest-neighbour voting in a latent semantic space.

A document's terms are its words (hashed to ``WORDS`` slots), the class trigrams of its characters
(letters, capitals, digits, spaces, line ends and single signs are the classes; hashed to ``SHAPES`` slots), and how much of it
repeats itself. A term's value is the square root of its share of the text, times a weight that is higher for terms in few
documents of the sample. A truncated singular value decomposition of the labelled sample's values gives the
latent space. The labelled vectors (``SAMPLE`` at most) are broadcast; every document's
cosines with all of them are computed exactly, in blocks, and the labels of the
``NEIGHBOURS`` nearest are weighted by similarity.

Only the text is an input of a score. The sample is the labelled rows with the lowest hashes of their ids, up to ``SAMPLE``.

Nulls and empty texts have no terms: their score is the share of label 1 in the sample. Labels
that are null don't count; a document labelled twice counts with the mean. Without any
label every score is 0.5. Of neighbours that tie for the last place the partition by ``argpartition`` picks, the same ones for the same text.
An empty table gives no rows; rows that repeat give rows that repeat. Very long texts are counted in blocks of a megabyte.
Columns of the table, whatever their names, are no inputs and stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.words import shingle_hashes, sliced, texts_of, word_hashes

SAMPLE = 6000
NEIGHBOURS = 25
DIMENSIONS = 64
CUT = 0.3
WORDS, SHAPES = 4096, 4096
#: Of words against shapes in a document's vector.
WORD_WEIGHT = 1.0
_EXTRA = 3
_WIDTH = WORDS + SHAPES + _EXTRA
#: Rows and bytes of text that are worked on together.
ROWS, BYTES = 256, 1 << 20

_CLASS = np.zeros(256, np.int32)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord(" ")] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = np.arange(5, 37)


def _shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each hashed class trigram occurs in each text."""
    n = len(offsets) - 1
    out = np.zeros(n * SHAPES, np.int32)
    for a in range(0, len(data) - 2, BYTES):
        c = _CLASS[data[a : a + BYTES + 2]]
        tri = (((c[:-2] * 37 + c[1:-1]) * 37 + c[2:]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
        at = np.arange(a, a + len(tri))
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[doc + 1]
        first, last = int(doc[0]), int(doc[-1]) + 1
        out[first * SHAPES : last * SHAPES] += np.bincount((doc[inside] - first) * SHAPES + tri[inside].astype(np.int64), minlength=(last - first) * SHAPES).astype(np.int32)
    return out.reshape(n, SHAPES)


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: square roots of the shares of its words and class trigrams, and of what repeats."""
    data, offsets = texts_of(column)
    n = len(column)
    out = np.zeros((n, _WIDTH), np.float32)
    if not len(data):
        return out
    words, bounds = word_hashes(column)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n), counts)
    slot = (words >> np.uint64(52)).astype(np.int64)
    out[:, :WORDS] = np.bincount(owner * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(1, counts)[:, None]
    out[:, WORDS : WORDS + SHAPES] = _shapes(data, offsets) / np.maximum(1, np.diff(offsets) - 2)[:, None]
    for k, gap in enumerate((1, 2)):
        if len(words) > gap:
            same = (words[gap:] == words[:-gap]) & (owner[gap:] == owner[:-gap])
            out[:, WORDS + SHAPES + k] = np.bincount(owner[gap:][same], minlength=n) / np.maximum(1, counts)
    shingles, cuts = shingle_hashes(words, bounds, 3)
    distinct = np.array([len(np.unique(shingles[a:b])) for a, b in zip(cuts, cuts[1:])])
    out[:, -1] = 1 - distinct / np.maximum(1, np.diff(cuts))
    out[np.diff(cuts) == 0, -1] = 0
    return np.sqrt(out, out=out)


class Sparse:
    """Rows of features of which most are 0, multiplied block by block."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.at = [np.frombuffer(x, "<u2") for x, _ in rows]
        self.values = [np.frombuffer(x, "<f2") for _, x in rows]

    def __len__(self) -> int:
        return len(self.at)

    def blocks(self):
        for a in range(0, len(self), ROWS):
            out = np.zeros((min(ROWS, len(self) - a), _WIDTH), np.float32)
            for i in range(len(out)):
                out[i, self.at[a + i]] = self.values[a + i]
            yield a, out

    def seen(self) -> np.ndarray:
        """The number of rows in which each feature occurs."""
        return sum(((x > 0).sum(axis=0) for _, x in self.blocks()), np.zeros(_WIDTH, np.int64))


class Voters:
    """The labelled vectors in the latent space."""

    def __init__(self, rows: Sparse, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        spread = np.log((1 + len(rows)) / (1 + rows.seen())) + 0.2
        spread[:WORDS] *= WORD_WEIGHT / max(1e-9, spread[:WORDS].mean())
        spread[-_EXTRA:] = 4.0
        self.weight = spread.astype(np.float32)
        rank = min(DIMENSIONS, len(rows))
        rng = np.random.default_rng(7)
        times = lambda q: np.concatenate([(x * self.weight) @ q for _, x in rows.blocks()])
        back = lambda q: sum((x * self.weight).T @ q[a : a + len(x)] for a, x in rows.blocks())
        q = np.linalg.qr(times(rng.standard_normal((_WIDTH, rank + 8)).astype(np.float32)))[0]
        for _ in range(2):
            q = np.linalg.qr(times(back(q)))[0]
        self.axes = np.linalg.svd(back(q).T, full_matrices=False)[2][:rank].T.copy()
        self.vectors = self._unit(times(self.axes))

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        k = min(NEIGHBOURS, len(self.labels))
        v = self._unit((x * self.weight) @ self.axes)
        out = np.full(len(v), self.prior)
        for a in range(0, len(v), ROWS):
            cosine = v[a : a + ROWS] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 8
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            some = (total > 0) & v[a : a + ROWS].any(axis=1)
            out[a : a + ROWS][some] = vote[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Voters | None:
    """Fit on a bounded sample of the labelled rows that aren't held out; None where there are none."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.avg(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches):
        for batch in sliced(batches, "text", BYTES, ROWS):
            x = features(batch.column("text"))
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([r[i].astype("<f2").tobytes() for r, i in zip(x, at)], pa.binary())],
                ["doc_id", "label", "at", "x"],
            )

    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = picked.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, at binary, x binary")
    rows = rows.orderBy("doc_id", "at", "x").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return None
    return Voters(Sparse(list(zip(rows["at"].to_pylist(), rows["x"].to_pylist()))), rows["label"].to_numpy())


def scored(docs: DataFrame, voters: Voters | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score, as column ``name``, for every row."""
    names = [c for c in keep if c != "text"]
    kept = docs.select(*names, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema) + f", `{name}` double"

    def run(batches):
        for batch in sliced(batches, "text", BYTES, ROWS):
            score = voters.scores(features(batch.column("text"))) if voters else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, name])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is ``cut`` or more."""
    name = scratch.free_name("__score", docs.columns)
    return scored(docs, trained(docs, labels), docs.columns, name).where(F.col(name) >= cut).select(*docs.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, trained(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
