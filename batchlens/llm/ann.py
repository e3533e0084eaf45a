"""Nearest neighbours by a forest of hash-prefix trees.

Each tree hashes a vector to a string of ``BITS`` signs of random projections of the centred
vector. All rows are indexed: a block of rows keeps, per tree, its hash strings as a sorted array. A query
descends each tree to its longest matching prefix (binary search in the sorted
array), then all trees ascend together, one bit at a time, until the rows below
the matched prefixes are enough; these are compared exactly, in double precision.

How many are enough is measured, not guessed: for ``CALIBRATION`` queries all distances are computed, and
the share of a block that a query gathers is the least that finds ``TARGET`` of their true neighbours.

Equal vectors are indexed once, with their 2k smallest ids, k of each at most; more can't be among anyone's k nearest.
Vectors are kept and compared as they come, in single or double precision. Each query meets each block once: that is
queries times rows, of which the calibrated share is compared; a share near 1 is what vectors without structure need.
Other columns of the table are not looked at.
Vectors that are null, zero, hold a null, NaN or infinity, or have another length than most
rows, take no part, and neither do rows without vec_id. Rows with the query's own vec_id aren't candidates. Ties
go to the smaller vec_id; candidates that repeat count once for each. Queries that repeat are one query; rows of one vec_id with
other vectors are queries of their own, each with its own ranks. Fewer than k candidates: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchlens.llm import scratch

TREES = 64
BITS = 24
BLOCK = 8192
QUERY_BLOCK = 256
CALIBRATION = 64
TARGET = 0.96
_FOREST = "block int, n int, vectors binary, ids array<array<long>>, codes binary, places binary"


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _kind(rows: DataFrame) -> str:
    """How vectors are kept: as they come, in single or double precision."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _least(ids: np.ndarray, k: int) -> np.ndarray:
    """Of ascending ids the 2k smallest, of each k at most: without any one id, the k smallest others are left."""
    other = np.ones(len(ids), bool)
    other[k:] = ids[k:] != ids[:-k] if len(ids) > k else other[k:]
    return ids[other][: 2 * k]


def _distinct(rows: DataFrame, width: int, k: int) -> DataFrame:
    """vector (binary), ids: the distinct vectors with those of their ids that can be among k nearest (``_least``)."""
    kind = _kind(rows)

    def run(batches):
        for batch in batches:
            x, ids = _matrix(batch.column("embedding"), width, kind) + np.zeros(1, kind), batch.column("vec_id").to_numpy()
            order = np.lexsort((ids, *x.T))
            new = np.flatnonzero(np.concatenate([[True], (x[order][1:] != x[order][:-1]).any(axis=1)])) if len(x) else []
            cuts = [*new, len(order)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[order[a]].tobytes() for a in new], pa.binary()), pa.array([_least(ids[order[a:b]], k).tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64()))],
                ["vector", "ids"],
            )

    some = rows.select("vec_id", "embedding").mapInArrow(run, "vector binary, ids array<long>")
    every = some.groupBy("vector").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    return every.select("vector", F.slice(F.filter("ids", lambda x, i: (i < k) | (F.get("ids", i - k) != x)), 1, 2 * k).alias("ids"))


def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((width, TREES * BITS)).astype(np.float32)


def _codes(x: np.ndarray, centre: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A row of hash strings (integers) for each tree."""
    bits = ((x.astype(np.float32) - centre) @ planes > 0).reshape(len(x), TREES, BITS)
    return (bits << np.arange(BITS - 1, -1, -1)).sum(axis=2).astype(np.uint32).T


def _centre(rows: DataFrame, width: int) -> np.ndarray:
    kind = _kind(rows)

    def run(batches):
        total, n = np.zeros(width), 0
        for batch in batches:
            x = _matrix(batch.column("embedding"), width, kind)
            total, n = total + x.sum(axis=0, dtype=np.float64), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([*total, float(n)])], ["i", "x"])

    got = {r["i"]: r["x"] for r in rows.select("embedding").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    return np.array([got[i] for i in range(width)], np.float32) / np.float32(got[width])


def build_forest(rows: DataFrame, width: int, k: int) -> tuple[DataFrame, np.ndarray, int]:
    """The blocks of the index (one row a block), the centre, and the number of blocks."""
    centre, kind = _centre(rows, width), _kind(rows)
    distinct = scratch.saved(_distinct(rows, width, k), "vectors")
    blocks = max(1, -(-distinct.count() // BLOCK))

    def run(batches):
        from pyspark import TaskContext

        vectors, ids = [], []
        for batch in batches:
            vectors += batch.column("vector").to_pylist()
            ids += batch.column("ids").to_pylist()
        if not ids:
            return
        x = np.frombuffer(b"".join(vectors), kind).reshape(len(ids), width)
        codes = _codes(x, centre, _planes(width))
        places = np.argsort(codes, axis=1, kind="stable")
        row = [TaskContext.get().partitionId(), len(ids), x.tobytes(), ids, np.take_along_axis(codes, places, 1).astype("<u4").tobytes(), places.astype("<u4").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["block", "n", "vectors", "ids", "codes", "places"])

    return scratch.saved(distinct.repartition(blocks).mapInArrow(run, _FOREST), "forest"), centre, blocks


class _Block:
    """One block of the index in a task."""

    def __init__(self, batch: pa.RecordBatch, i: int, width: int, kind: str):
        self.n = batch.column("n")[i].as_py()
        self.x = np.frombuffer(batch.column("vectors")[i].as_buffer(), kind).reshape(self.n, width).astype(np.float64)
        ids = batch.column("ids")[i].values
        sizes = np.diff(ids.offsets.to_numpy())
        self.owner, self.ids = np.repeat(np.arange(self.n), sizes), ids.flatten().to_numpy()
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u4").reshape(TREES, self.n)
        self.places = np.frombuffer(batch.column("places")[i].as_buffer(), "<u4").reshape(TREES, self.n)

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each depth, tree and query, the range of the sorted array that shares the query's prefix."""
        lo = np.zeros((BITS + 1, TREES, codes.shape[1]), np.int32)
        hi = np.full_like(lo, self.n)
        for d in range(1, BITS + 1):
            rest = np.uint32((1 << (BITS - d)) - 1)
            for t in range(TREES):
                lo[d, t] = np.searchsorted(self.codes[t], codes[t] & ~rest, "left")
                hi[d, t] = np.searchsorted(self.codes[t], codes[t] | rest, "right")
        return lo, hi

    def gathered(self, lo: np.ndarray, hi: np.ndarray, depth: int, least: int) -> np.ndarray:
        """The rows below the prefixes of ``depth`` bits in all trees; shorter prefixes until there are ``least``."""
        while True:
            mark = np.zeros(self.n, bool)
            for t in range(TREES):
                mark[self.places[t, lo[depth, t] : hi[depth, t]]] = True
            if depth == 0 or mark.sum() >= least:
                return np.flatnonzero(mark)
            depth -= 1

    def nearest(self, q: np.ndarray, own: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest ids among ``rows`` of the block, their distances, and their rows."""
        d = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        if len(d) > k + 1:
            limit = np.partition(d, k)[k]
            rows, d = rows[d <= limit], d[d <= limit]
        sizes = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ids, d, rows = self.ids[at], np.repeat(d, sizes), np.repeat(rows, sizes)
        other = ids != own
        ids, d, rows = ids[other], d[other], rows[other]
        order = np.lexsort((ids, d))[:k]
        return ids[order], d[order], rows[order]


def _compared(forest: DataFrame, queries: DataFrame, blocks: int, centre: np.ndarray, width: int, k: int, share: float | None) -> DataFrame:
    """query_id, mark, vec_id, score, need: each query's k nearest of what is gathered in each block.

    Without ``share`` all rows are compared, and ``need`` is the share of the block that is gathered
    before the neighbour is.
    """

    kind = _kind(queries)

    def packed(batches):
        held = [b for b in batches if len(b)]
        if held:
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            x = np.concatenate([_matrix(b.column("embedding"), width, kind) for b in held])
            marks = np.concatenate([b.column("mark").to_numpy() for b in held])
            for a in range(0, len(ids), QUERY_BLOCK):
                own = slice(a, a + QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (ids[own].astype("<i8").tobytes(), marks[own].astype("<i8").tobytes(), x[own].astype(kind).tobytes())], ["q_ids", "q_marks", "q_vectors"])

    asked = queries.select("vec_id", "mark", "embedding").mapInArrow(packed, "q_ids binary, q_marks binary, q_vectors binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches):
        planes = _planes(width)
        for batch in batches:
            for i in range(len(batch)):
                block = _Block(batch, i, width, kind)
                own, marks = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("q_ids", "q_marks"))
                q = np.frombuffer(batch.column("q_vectors")[i].as_buffer(), kind).reshape(len(own), width)
                lo, hi = block.ranges(_codes(q, centre, planes))
                gathered = (hi - lo).sum(axis=1)
                out = []
                for j in range(len(own)):
                    if share is None:
                        rows = np.arange(block.n)
                    else:
                        rows = block.gathered(lo[:, :, j], hi[:, :, j], int(np.flatnonzero(gathered[:, j] >= min(share, TREES) * block.n).max(initial=0)), k + 1)
                    ids, d, at = block.nearest(q[j].astype(np.float64), own[j], rows, k)
                    need = np.zeros(len(ids))
                    if share is None:
                        for m, r in enumerate(at):
                            place = [np.flatnonzero(block.places[t] == r)[0] for t in range(TREES)]
                            inside = ((lo[:, :, j] <= place) & (place < hi[:, :, j])).any(axis=1)
                            depth = int(np.flatnonzero(inside).max())
                            need[m] = (gathered[depth + 1, j] if depth < BITS else 0) / block.n
                    out.append((np.full(len(ids), own[j]), np.full(len(ids), marks[j]), ids, d, need))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "mark", "vec_id", "score", "need"])

    return forest.join(asked, "block").mapInArrow(run, "query_id long, mark long, vec_id long, score double, need double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``rows`` (vec_id, embedding) with ``is_query``."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return empty
    width = widths["w"]
    rows = rows.where(F.size("embedding") == width)
    forest, centre, blocks = build_forest(rows, width, k)
    zero = F.lit(0).cast(rows.schema["embedding"].dataType.elementType)  # so that a negative zero has no mark of its own
    queries = rows.where(is_query).withColumn("mark", F.xxhash64(F.transform("embedding", lambda x: x + zero))).dropDuplicates(["vec_id", "mark"])
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION)
    needs = [r["need"] for r in _ranked(_compared(forest, sample, blocks, centre, width, k, None), k).select("need").collect()]
    if not needs:
        return empty
    share = float(np.quantile(needs, TARGET)) + 1e-6
    found = _ranked(_compared(forest, queries, blocks, centre, width, k, share), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(rows, F.col("vec_id") % 100 == 0)
