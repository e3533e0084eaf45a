"""Near duplicates of embeddings by spherical caps of a random product code.

A vector's filters are directions whose cap it lies in. The directions are a product code: the rotated space is cut into up to four blocks, each block has
its own random codewords, and a direction is one codeword of each block, so there are many more directions (``DIRECTIONS``
times the distinct vectors of the largest label) than codewords to compare. List decoding
walks the blocks and keeps the partial sums from which the cap can still be reached, so it gives all directions past the cap without trying each.
Vectors that share a filter and a label are compared by their exact cosine.

The cap's height is that which one random direction passes with a chance of ``LIST`` in all directions; where a vector's best
direction is not past it by ``WIDEN`` times the spread of a linked pair, its cap is lowered to that much below its best one, so each vector has
filters. Recall is measured against brute force in the tests (above 0.999 for pairs exactly at the threshold). Rotation and codewords are integers, and vectors are
rounded to integers, so that a vector has the same filters in each task.

Equal vectors of a label are one member with a number of copies. A pair that meets in several filters is counted in the first of them only, for which linked members'
filters are decoded again; no pair becomes a row. Members of a filter beyond ``SPLIT`` are compared in tasks for each two parts
of them. That is exact for any group; the comparisons of one huge group of vectors that are all near each other, but not equal, grow with the square of its size,
as the number of its links does.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most rows, link with nothing, nor do rows without label or vec_id. Rows that
repeat or share a vec_id are vectors of their own, linked as copies; a component's id is the smallest vec_id in it. Components that are not linked are the vector itself; its id is then its own, null without
one. Columns other than vec_id, embedding and label are not looked at, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.ann import usable
from batchlens.llm.components import components

DIRECTIONS = 16
LIST = 2.0
WIDEN = 1.25
SPLIT = 256
_SCALE, _GRAIN = 1 << 20, 1 << 12
_FEW = 32


class ProductCode:
    """Directions of the unit sphere, and the list decoding of vectors to those whose caps they lie in."""

    def __init__(self, width: int, vectors: int, threshold: float, seed: int = 13):
        self.width, self.size = width, max(4, 1 << (width - 1).bit_length())
        self.blocks = min(4, max(1, self.size // 8))
        self.words = max(8, int(np.ceil((DIRECTIONS * max(vectors, 1)) ** (1 / self.blocks))))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (2, self.size))
        code = rng.standard_normal((self.blocks, self.words, self.size // self.blocks))
        self.code = np.rint(code / np.linalg.norm(code, axis=2, keepdims=True) * _GRAIN)
        one = _SCALE * self.size * _GRAIN * np.sqrt(self.blocks)  # a cosine of 1 in the integers' scale
        self.height = one * NormalDist().inv_cdf(1 - LIST / float(self.words) ** self.blocks) / np.sqrt(self.size)
        self.slack = one * WIDEN * np.sqrt(max(0.0, 2 - 2 * threshold) / self.size)

    def _rotated(self, x: np.ndarray) -> np.ndarray:
        """Two rounds of sign changes and Walsh-Hadamard transforms, in exact integers."""
        y = np.zeros((len(x), self.size))
        y[:, : self.width] = np.rint(x / np.sqrt((x * x).sum(axis=1))[:, None] * _SCALE)
        for signs in self.signs:
            y, half = y * signs, 1
            while half < self.size:
                z = y.reshape(len(y), -1, 2, half)
                y, half = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), -1), 2 * half
        return y

    def decoded(self, x: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for all directions in whose caps the rows of ``x`` lie, ascending in rows."""
        out = []
        for first in range(0, len(x), rows):
            y = self._rotated(x[first : first + rows]).reshape(-1, self.blocks, self.size // self.blocks)
            dots = np.stack([y[:, b] @ self.code[b].T for b in range(self.blocks)], 1)
            best = dots.max(axis=2)
            rest = np.concatenate([np.cumsum(best[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], 1)  # the most that blocks from b on can add
            limit = np.minimum(self.height, rest[:, 0] - self.slack)
            row, total, at = np.arange(len(y)), np.zeros(len(y)), np.zeros(len(y), np.int64)
            for b in range(self.blocks):
                sums = total[:, None] + dots[row, b]
                i, word = np.nonzero(sums + rest[row, b + 1][:, None] >= limit[row][:, None])
                row, total, at = row[i], sums[i, word], at[i] * self.words + word
            out.append((row + first, at))
        return (np.concatenate([o[i] for o in out]) for i in (0, 1)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each row's smallest row of its component, so far) after the links a-b."""
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _cosines(x: np.ndarray, norms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b])


def _few_pairs(x, norms, sizes, starts, side, both, threshold):
    """The linked pairs of all small groups: ``side`` is the part of a row, ``both`` whether the group compares two parts."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
    last = np.repeat(starts + sizes, sizes)
    many = last - at - 1
    a = np.repeat(at, many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + a + 1
    ok = ~np.repeat(both[group], many) | (side[a] != side[b])
    a, b = a[ok], b[ok]
    linked = np.concatenate([_cosines(x, norms, a[i : i + 65536], b[i : i + 65536]) >= threshold for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    return a[linked], b[linked]


def _many_pairs(x, norms, start, stop, side, both, threshold):
    """The linked pairs of a large group, a block of rows at a time."""
    unit = x[start:stop] / norms[start:stop, None]
    for first in range(0, stop - start, 512):
        a, b = np.nonzero(unit[first : first + 512] @ unit[first:].T >= threshold - 1e-9)
        a, b = a[b > a], b[b > a]
        a, b = a + first + start, b + first + start
        if both:
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        for i in range(0, len(a), 65536):
            own = slice(i, i + 65536)
            linked = _cosines(x, norms, a[own], b[own]) >= threshold
            yield a[own][linked], b[own][linked]


def _filters_before(code: ProductCode, x: np.ndarray, rows: np.ndarray, cap: np.ndarray) -> dict[int, set[int]]:
    """For each of ``rows`` the directions before that of its group."""
    row, at = code.decoded(x[rows])
    earlier = at < cap[rows[row]]
    out: dict[int, set[int]] = {int(r): set() for r in rows}
    for r, d in zip(rows[row[earlier]].tolist(), at[earlier].tolist()):
        out[r].add(d)
    return out


def _found(code: ProductCode, threshold: float, keys, copies, x, cap, part, side, both):
    """key, peer (a key of the same component), links (copies of linked members, each pair in its first filter only) of the linked members of whole groups."""
    norms = np.sqrt((x * x).sum(axis=1))
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sizes = np.diff(new, append=len(part))
    root, links = np.arange(len(part)), np.zeros(len(part), np.int64)

    def count(a, b):
        nonlocal root
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = _merged(root, a, b)

    few = sizes <= _FEW
    if few.any():
        a, b = _few_pairs(x, norms, sizes[few], new[few], side, both[new[few]], threshold)
        if len(a):
            before = _filters_before(code, x, np.unique(np.concatenate([a, b])), cap)
            first = np.array([before[i].isdisjoint(before[j]) for i, j in zip(a.tolist(), b.tolist())], bool)
            count(a[first], b[first])
    for start, n in zip(new[~few], sizes[~few]):
        row, at = code.decoded(x[start : start + n])
        kinds, kind, times = np.unique(at, return_inverse=True, return_counts=True)
        shared = (kinds < cap[start]) & (times > 1)
        holds = np.zeros((n, int(shared.sum())), np.float32)
        own = shared[kind]
        holds[row[own], (np.cumsum(shared) - 1)[kind[own]]] = 1
        for a, b in _many_pairs(x, norms, start, start + n, side, both[start], threshold):
            i, j = a - start, b - start
            low, high = (int(i.min()), int(i.max()) + 1) if len(i) else (0, 0)
            first = (holds[low:high] @ holds.T == 0)[i - low, j] if len(i) and holds.shape[1] else np.ones(len(i), bool)
            count(a[first], b[first])
    some = np.flatnonzero(links)
    return keys[some], keys[root[some]], links[some]


def _compared(live: DataFrame, code: ProductCode, threshold: float, kind: str) -> DataFrame:
    """What the filters' groups give; ``live``: label, cap, i, j, chunk, key, copies, vector."""
    names = ["cap", "i", "j", "chunk", "key", "copies"]

    def run(batches):
        held = None

        def done(part):
            x = np.frombuffer(b"".join(part["vector"].to_pylist()), kind).reshape(len(part), code.width).astype(np.float64)
            cap, i, j, chunk, key, copies = (part[c].to_numpy() for c in names)
            label = part["label"].combine_chunks().dictionary_encode().indices.to_numpy() if len(part) else np.zeros(0)
            new = np.concatenate([[True], (cap[1:] != cap[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (label[1:] != label[:-1])])
            out = _found(code, threshold, key, copies, x, cap, np.cumsum(new), chunk, i != j)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["key", "peer", "links"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < 4096:
                continue
            last = {c: held[c][len(held) - 1].as_py() for c in ("label", "cap", "i", "j")}
            cut = len(held) - 1
            same = np.logical_and.reduce([np.array(held[c].to_pylist(), object) == v for c, v in last.items()])
            cut = int(np.flatnonzero(~same).max(initial=-1)) + 1  # the last group may go on
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield done(held)

    groups = live.repartition("label", "cap", "i", "j").sortWithinPartitions("label", "cap", "i", "j", "key")
    return groups.select("label", *names, "vector").mapInArrow(run, "key long, peer long, links long")


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding, label): links are cosines of ``threshold`` or more within a label."""
    spark = rows.sparkSession
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    zero = F.lit(0).cast(rows.schema["embedding"].dataType.elementType)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    own = own.select("vec_id", "label", F.when(good, F.transform("embedding", lambda x: x + zero)).alias("x"))  # no negative zeros
    widths = own.where("x is not null").groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 0
    x = F.when(F.size("x") == width, F.col("x"))
    signs = F.xxhash64(x).alias("sig1"), F.xxhash64(F.lit(29), x).alias("sig2")
    own = scratch.saved(own.select("vec_id", "label", x.alias("x"), *signs, F.monotonically_increasing_id().alias("key")), "vectors")

    sig = ["label", "sig1", "sig2"]
    classes = own.where("x is not null").groupBy(*sig).agg(F.min("key").alias("key"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = scratch.saved(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    code = ProductCode(max(width, 1), most, threshold)

    def decode(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, code.width)
            row, at = code.decoded(x)
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(row)), pa.array(at), pa.array(keys[row])], ["label", "cap", "key"])

    def packed(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, code.width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "copies", "vector"])

    heads = own.where("x is not null").select("key", "x", "label").join(classes.select("key", "copies"), "key")
    heads = scratch.saved(heads, "heads")
    caps = scratch.saved(heads.select("label", "key", "x").mapInArrow(decode, "label string, cap long, key long"), "caps")
    groups = caps.groupBy("label", "cap").count().where("count > 1")
    parts = F.ceil(F.col("count") / SPLIT).cast("int")
    live = caps.join(groups.select("label", "cap", parts.alias("parts")), ["label", "cap"])
    live = live.join(heads.select("key", "copies", "x").mapInArrow(packed, "key long, copies long, vector binary"), "key")
    live = live.withColumn("chunk", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    live = live.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    found = scratch.saved(_compared(live, code, threshold, kind), "found")

    edges = components(found.where("key <> peer").select(F.col("key").alias("a"), F.col("peer").alias("b")).distinct())
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.join(links, "key", "left").join(edges.withColumnRenamed("id", "key"), "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("low").alias("least"))
    known = scratch.saved(known.join(least, "component").select(*sig, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least"), "known")
    out = own.withColumn("label", F.when(F.col("x").isNotNull(), F.col("label"))).join(known, sig, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op13_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
with recursive v as (select row_number() over () as row, vec_id, label, cast(embedding as double[]) as x from embeddings),
g as (select *, sqrt(list_sum(list_transform(x, lambda a: a * a))) as norm from v where label is not null and x is not null and vec_id is not null
  and len(list_filter(x, lambda a: a is null or not isfinite(a))) = 0 and len(list_filter(x, lambda a: a <> 0)) > 0),
e as (select a.row as a, b.row as b from g a join g b on a.label = b.label and a.row <> b.row and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r(row, reach) as (select row, row from v union select r.row, e.b from r join e on e.a = r.reach),
c as (select r.row, min(v.vec_id) as least from r join v on v.row = r.reach group by r.row),
n as (select a as row, count(*) as links from e group by a)
select v.vec_id, coalesce(n.links, 0) as n_links, c.least as component_id, v.vec_id = c.least as kept from v join c on c.row = v.row left join n on n.row = v.row
"""
