"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item all windows of a document that have as many words as
the item (the whole document where it has fewer) and share at least one shingle
with it get a 64-bit SimHash of their shingles, weighted by how often each occurs. A
multi-index over four 16-bit blocks finds every item fingerprint within ``RADIUS`` = 15
bits: of 15 differing bits, some block has at most 3, so each block of a window is looked up
with all sets of up to 3 bits flipped; the index lists each item once a block. The candidates are then verified by
the exact weighted Jaccard similarity of window and item (sum of minima over sum of maxima).
A window without any shared shingle has similarity 0, so leaving it out loses nothing.

Words are compared in lower case without punctuation. The benchmark's index is cut into files for ``MOST_ITEM_BYTES``
of items each (about 30 bytes a word); a scan works off one after the other.

Nulls and empty texts contain nothing and match nothing; items with fewer words than
a shingle are one shingle of all their words, found where a window of so many words is equal; rows that repeat give rows that repeat; items with equal
text all match. Empty tables give no rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import pickle
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.words import mix, shingle_hashes, sliced, word_hashes

RADIUS = 15
_NEAR = 3
MOST_ITEM_BYTES = 4 << 20
#: Places of a document that are worked on together.
SPAN = 16_384
_BITS = np.arange(64, dtype=np.uint64)
_FLIPS = np.array([sum(1 << b for b in c) for n in range(_NEAR + 1) for c in combinations(range(16), n)], np.uint16)


def plain_words(text):
    """Lower case, with every run of other characters than letters, digits and marks made one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " ")


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs (+1, -1) for each shingle."""
    return ((mix(shingles)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash of rows of sums of signs."""
    return np.where(sums > 0, np.uint64(1) << _BITS, np.uint64(0)).sum(axis=1, dtype=np.uint64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of shingles."""
    x, y = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(x[1][i], y[1][j]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


class Index:
    """The benchmark's items: shingles, fingerprints, and the multi-index over their blocks."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        words, bounds = word_hashes(pa.array(texts, pa.string()))
        shingles, at = shingle_hashes(words, bounds, k)
        keep = np.diff(at) > 0
        self.ids = np.array(ids, np.int64)[keep]
        self.words = np.diff(bounds)[keep]
        self.shingles = [shingles[a:b] for a, b, ok in zip(at, at[1:], keep) if ok]
        for n in {int(n) for n in self.words if n < k}:  # the hashes that windows of so many words have
            grams, cuts = shingle_hashes(words, bounds, n)
            for i, row in enumerate(np.flatnonzero(keep)):
                if self.words[i] == n:
                    self.shingles[i] = grams[cuts[row] : cuts[row] + 1]
        self.prints = fingerprint(np.array([signs(s).sum(axis=0) for s in self.shingles]).reshape(-1, 64))
        flat = np.concatenate(self.shingles) if self.shingles else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.shingles)), [len(s) for s in self.shingles])
        pairs = np.unique(np.array([flat, owner.astype(np.uint64)]), axis=1) if len(flat) else np.zeros((2, 0), np.uint64)
        order = np.lexsort((pairs[1], pairs[0]))
        self.key, self.owner = pairs[0][order], pairs[1][order].astype(np.int64)
        #: Items with fewer words than a shingle, by their number of words: the one hash of each, and the item.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, (s, n) in enumerate(zip(self.shingles, self.words.tolist())):
            if n < k:
                self.short.setdefault(n, []).append((int(s[0]), i))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.key >> np.uint64(44)).astype(np.int64)] = True
        #: Of each block: whether an item has the value, where its items begin, and the items by value.
        self.blocks = []
        for b in range(4):
            value = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            by = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[by], np.arange((1 << 16) + 1))
            self.blocks.append((np.diff(starts) > 0, starts, by))

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``shingles`` and items that have the shingle there."""
        maybe = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        x = shingles[maybe]
        first, last = np.searchsorted(self.key, x, "left"), np.searchsorted(self.key, x, "right")
        n = last - first
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(maybe, n), self.owner[np.repeat(first, n) + inner]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (fingerprint, item) within RADIUS bits: each block's value is looked up with up to _NEAR bits flipped."""
        pairs = [np.zeros(0, np.int64)]
        for a in range(0, len(prints), 512):
            for b, (some, starts, items) in enumerate(self.blocks):
                value = ((prints[a : a + 512] >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
                flipped = value[:, None] ^ _FLIPS
                w, f = np.nonzero(some[flipped])
                value = flipped[w, f].astype(np.int64)
                n = starts[value + 1] - starts[value]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append((np.repeat(w, n) + a) * len(self.ids) + items[np.repeat(starts[value], n) + inner])
        pair = np.unique(np.concatenate(pairs))
        w, i = np.divmod(pair, max(1, len(self.ids)))
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]


def _in_document(index: Index, shingles: np.ndarray, n_words: int, at: np.ndarray, items: np.ndarray, k: int, least: float) -> list[tuple[int, int, float]]:
    """(item, first word of the best window, similarity) for one document's shared shingles.

    Windows are worked on ``SPAN`` places at a time, so memory doesn't grow with the document beyond its shingles.
    """
    best: dict[int, tuple[float, int]] = {}
    for size in np.unique(np.minimum(index.words[items], n_words)):
        n = max(1, int(size) - k + 1)
        own = at[np.minimum(index.words[items], n_words) == size]
        reach = np.zeros(len(shingles) + 1, np.int32)
        np.add.at(reach, np.maximum(own - n + 1, 0), 1)
        np.add.at(reach, own + 1, -1)
        starts = np.flatnonzero(np.cumsum(reach)[: max(1, len(shingles) - n + 1)] > 0)
        for some in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
            if not len(some):
                continue
            lo = some[0]
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(shingles[lo : some[-1] + n]), axis=0, dtype=np.int32)])
            w, i = index.near(fingerprint(sums[some - lo + n] - sums[some - lo]))
            same = np.minimum(index.words[i], n_words) == size
            for s, item in zip(some[w[same]].tolist(), i[same].tolist()):
                value = weighted_jaccard(shingles[s : s + n], index.shingles[item])
                if value >= least and value > best.get(item, (0.0, 0))[0]:
                    best[item] = (value, s)
    return [(item, s, value) for item, (value, s) in sorted(best.items())]


def _indexes(benchmark: DataFrame, k: int) -> list[str]:
    """The benchmark in index files of bounded size in the shared folder; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), plain_words(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes, path = -(-size // MOST_ITEM_BYTES), scratch.new_path(benchmark.sparkSession, "benchmark")
    for p in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        got = own.orderBy("item_id", "text").collect()
        scratch.put_bytes(f"{path}/{p}", [pickle.dumps(Index([r["item_id"] for r in got], [r["text"] for r in got], k))])
    return [f"{path}/{p}" for p in range(passes)]


@lru_cache(maxsize=2)
def _index(path: str) -> Index:
    return pickle.loads(scratch.mapped(path).tobytes())


def _found(index: Index, column: pa.Array, k: int, least: float) -> list[tuple[int, int, int, float]]:
    """(row, item, first word, similarity) of the matches in a column of texts."""
    words, bounds = word_hashes(column)
    shingles, cuts = shingle_hashes(words, bounds, k)
    at, items = index.hits(shingles)
    doc, rows = np.searchsorted(cuts, at, "right") - 1, []
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-2)) if len(doc) else []
    for a, b in zip(edges, edges[1:]):
        d = int(doc[a])
        own = _in_document(index, shingles[cuts[d] : cuts[d + 1]], int(bounds[d + 1] - bounds[d]), at[a:b] - cuts[d], items[a:b], k, least)
        rows += [(d, *x) for x in own if index.words[x[0]] >= k]
    for n, known in index.short.items():
        grams, cuts = shingle_hashes(words, bounds, n)
        for value, item in known:
            hit = np.flatnonzero(grams == np.uint64(value))
            doc = np.searchsorted(cuts, hit, "right") - 1
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            rows += [(int(doc[f]), item, int(hit[f] - cuts[doc[f]]), 1.0) for f in first if bounds[doc[f] + 1] - bounds[doc[f]] >= n]
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, first_word, similarity: the best window of each pair with similarity ``least`` or more."""
    schema = "doc_id long, item_id long, first_word long, similarity double"
    texts = docs.select(F.col("doc_id").cast("long"), plain_words(F.col("text")).alias("text"))

    paths = _indexes(benchmark, k)

    def run(batches):
        for batch in sliced(batches, "text"):
            for path in paths:
                index = _index(path)
                rows = _found(index, batch.column("text"), k, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([int(index.ids[r[1]]) for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64()),
                    ],
                    ["doc_id", "item_id", "first_word", "similarity"],
                )

    return texts.mapInArrow(run, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    plain, paths = scratch.free_name("__plain", docs.columns), _indexes(benchmark, k)

    def run(batches):
        for batch in sliced(batches, plain):
            keep = np.ones(len(batch), bool)
            for path in paths:
                keep[[r[0] for r in _found(_index(path), batch.column(plain), k, least)]] = False
            yield batch.drop_columns([plain]).filter(pa.array(keep))

    return docs.withColumn(plain, plain_words(F.col("text"))).mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
