"""Exact Jaccard join on word n-grams with adaptive multi-match prefixes.

A document's shingles are put in one order for the whole corpus, rare ones first. Two documents
with ``100 * intersection >= percent * union`` share at least l shingles among the
first n - ceil(percent * n / 100) + l of each, for every l up to ceil(percent * n / 100), the least
that a linked pair has in common. Each document picks the l that costs
least, estimated from how often its prefix shingles occur, and needs l shared prefix
shingles before a pair is verified.

Documents with equal sets are one class. Within the list of a shingle, classes are first verified
against one centre only, so a large group of near copies needs one pair a member and list; after that
only pairs whose ends aren't connected yet are looked at, which loses no component.

Defined cases: no words, an empty or a null text: the empty set, linked with nothing (its own
component). Fewer words than a shingle: one shingle of all. Rows that repeat, or share a doc_id, are
separate rows; a component's id is the smallest doc_id in it, null if it has none. An empty table gives no rows.
A very long text's set is held whole in its task. Columns other than doc_id and text are not looked at (``one_of_each``
keeps them, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.components import components
from batchlens.llm.counts import characters, slot_counts
from batchlens.llm.words import shingle_hashes, sliced, word_hashes

LONGEST = 6
_CHECK = 8.0
#: A list with more members is compared in as many tasks, each with this many of one side and all of the other.
SPLIT = 2048
_MASK = 1024
_SETS = "doc_id long, n long, sig1 long, sig2 long, first int, matches int, tokens array<long>, levels array<int>, mask array<long>, items binary"


def _prefixes(tokens: np.ndarray, times: np.ndarray, percent: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Unshared tokens at the front, l, and the shared tokens of the longest prefix with the level at which each joins."""
    n = len(tokens)
    least = -(-percent * n // 100)
    base = n - least + 1
    alone = int((times == 1).sum())
    if alone >= base:
        return alone, 1, tokens[:0], times[:0].astype(np.int32)
    order = np.lexsort((tokens, times))[alone : min(n, base + LONGEST - 1)]
    level = np.maximum(1, np.arange(alone, alone + len(order)) - base + 2).astype(np.int32)
    reach = np.array([times[order][level <= m].sum(dtype=np.float64) for m in range(1, LONGEST + 1)])
    most = min(LONGEST, len(order), least)
    cost = reach + _CHECK * reach / np.arange(1, LONGEST + 1)
    return alone, int(np.argmin(cost[:most])) + 1, tokens[order], level


def _mask(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of _MASK residues that some token has, as 64-bit integers."""
    bits = np.zeros(_MASK, bool)
    bits[(tokens >> np.uint64(20)).astype(np.int64) % _MASK] = True
    return np.packbits(bits).view(np.int64)


def _shingle_sets(docs: DataFrame, k: int, percent: int, key: str | None) -> DataFrame:
    """Of each row: the size and signature of its set, its prefix, and (where it can match at all) the set."""
    own = [F.col(key).cast("long").alias("key")] if key else []
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)

    def shingles(batch):
        return np.concatenate([shingle_hashes(*word_hashes(b.column("text")), k)[0] for b in sliced([batch], "text")] or [np.zeros(0, np.uint64)])

    counts = slot_counts(text.select("text"), shingles, characters(docs))

    def run(batches):
        for batch in sliced(batches, "text"):
            every, cuts = shingle_hashes(*word_hashes(batch.column("text")), k)
            sets = [np.unique(every[a:b]) for a, b in zip(cuts, cuts[1:])]
            flat = np.concatenate(sets)
            times, at = counts.of(flat), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            rows = []
            for s, a, b in zip(sets, at, at[1:]):
                if not len(s):
                    rows.append((0, 0, 0, 0, 1, [], [], None, None))
                    continue
                alone, matches, tokens, level = _prefixes(s, times[a:b], percent)
                sig = int(np.bitwise_xor.reduce(s)), int((s * (s | np.uint64(1))).sum(dtype=np.uint64))
                sig = tuple(x - (1 << 64) if x >> 63 else x for x in sig)
                rows.append((len(s), *sig, alone, matches, tokens.view(np.int64), level, *((_mask(s), s.astype("<u8").tobytes()) if len(tokens) else (None, None))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            names = ["doc_id", "n", "sig1", "sig2", "first", "matches", "tokens", "levels", "mask", "items"]
            keys = [batch.column("key")] if key else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), *keys], names + ["key"] * bool(key))

    sets = text.mapInArrow(run, _SETS + ", key long" * bool(key))
    return scratch.saved(sets if key else sets.withColumn("key", F.monotonically_increasing_id()), "shingle-sets")


def _possible(x: dict, y: dict, percent: int):
    """Whether two classes that meet at a token can be linked; never false for two that are and meet there first.

    They share at most what is shared in front of the token (no more than either's shared
    tokens there) and the fewer of what is left; and at most what either has less the bits of
    its mask that the other's lacks.
    """
    need = F.lit(percent) * (x["n"] + y["n"])
    before = F.least(x["at"] - x["first"], y["at"] - y["first"])
    shared = before + F.least(x["n"] - x["at"], y["n"] - y["at"])
    lacks = lambda p, q: sum(F.bit_count(p["mask"][i].bitwiseAND(F.bitwise_not(q["mask"][i]))) for i in range(_MASK // 64))
    common = F.least(x["n"] - lacks(x, y), y["n"] - lacks(y, x))
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & (shared * (100 + percent) >= need) & (common * (100 + percent) >= need)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    one = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return scratch.saved(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "linked")


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80, key: str | None = None) -> DataFrame:
    """doc_id, key (of the row), n_shingles, class_id, part, component_id of every row of ``docs`` (doc_id, text).

    ``key`` names a column that differs for each row; without one, rows are numbered. Rows of one component have the same ``part``.
    """
    sets = _shingle_sets(docs, k, percent, key)
    sig = ["n", "sig1", "sig2"]
    classes = sets.where("n > 0").groupBy(*sig).agg(F.min("key").alias("class"), F.min("doc_id").alias("low"))
    classes = scratch.saved(classes, "classes")
    heads = sets.where("items is not null").join(classes.select(F.col("class").alias("key")), "key", "left_semi")
    heads = scratch.saved(heads, "heads")
    lists = heads.select("key", "n", "first", "matches", "mask", F.posexplode(F.arrays_zip("tokens", "levels")).alias("i", "t"))
    lists = lists.select("key", "n", "first", (F.col("first") + F.col("i")).alias("at"), "matches", "mask", F.col("t.tokens").alias("token"), F.col("t.levels").alias("level"))

    ones = lists.where("level = 1")
    centres = ones.groupBy("token").agg(F.min(F.struct("first", "key")).alias("c"), F.count("*").alias("m")).where("m > 1")
    stars = ones.join(centres.select("token", F.col("c.key").alias("b")), "token").where("key <> b")
    near = _verified(stars.select(F.col("key").alias("a"), "b").distinct(), heads, percent)
    known = components(near)

    member = F.coalesce(F.col("component"), F.col("key")).alias("part")
    lists = scratch.saved(lists.join(known.withColumnRenamed("id", "key"), "key", "left").select("key", "n", "first", "at", "matches", "mask", "token", "level", member), "lists")
    open_ = lists.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    open_ = scratch.saved(lists.join(open_.select("token", F.ceil(F.col("m") / SPLIT).cast("int").alias("splits")), "token"), "open-lists")
    names = ("key", "n", "first", "at", "part", "matches", "level", "mask")
    x, y = ({c: F.col(f"{side}_{c}") for c in names} for side in "ab")
    one, two = (open_.select("token", split, *(F.col(c).alias(f"{side}_{c}") for c in names)) for side, split in (("a", F.pmod(F.xxhash64("key"), "splits").cast("int").alias("split")), ("b", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))))
    matched = (x["key"] > y["key"]) & (x["part"] != y["part"]) & (x["level"] <= x["matches"]) & (y["level"] <= x["matches"])
    met = one.join(two, ["token", "split"]).where(matched & _possible(x, y, percent)).select(x["key"].alias("a"), y["key"].alias("b"), x["matches"].alias("l"))
    pairs = met.groupBy("a", "b", "l").count().where("count >= l").select("a", "b")
    far = _verified(pairs, heads, percent)
    final = components(near.union(far))

    rows = sets.select("key", "doc_id", *sig).join(classes, sig, "left")
    rows = rows.join(final.withColumnRenamed("id", "class"), "class", "left")
    rows = rows.withColumn("part", F.coalesce("component", "class", "key"))
    least = classes.join(final.withColumnRenamed("id", "class"), "class", "left").groupBy(F.coalesce("component", "class").alias("part")).agg(F.min("low").alias("low"))
    least = scratch.saved(least, "least")  # a table of its own, so that a large component's rows can be split in the join
    rows = rows.join(least.select("part", F.col("low").alias("least")), "part", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("class", "key").alias("class_id"), "part", own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that with the smallest doc_id (nulls last), then the first."""
    key = scratch.free_name("__row", docs.columns)
    rows = scratch.saved(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    links = linked_documents(rows, k, percent, key)
    first = links.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    return rows.join(first.select(F.col("f.key").alias(key)), key, "left_semi").select(*docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return linked_documents(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")
