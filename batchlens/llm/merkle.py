"""A Merkle manifest of a table, with each row's authentication path by fractal traversal.

Rows are numbered within their source (range partitions, then offsets of each partition), and
aligned blocks of ``BLOCK`` leaves are gathered. A block's levels are cut into stages of ``STEP`` levels. The traversal
walks the leaves from left to right and keeps two subtrees a stage: the existing one, that holds the
siblings of the current leaf, and the desired one to its right, that takes in one leaf a step and is complete when
the walk enters it. A subtree drops its nodes below its stage as soon as their parent is made, so memory
is a few subtrees and the block's leaves. Block roots are numbered nodes themselves: their tree is built from blocks in the same way, round after round,
until each source has one node, its subroot; so is the tree over the subroots. Paths are then
made from the top down: a block's rows get the block's own path appended.

A node is the hex sha256 of its run: up to three consecutive nodes of the level below, as hex text. Every
level runs up to a single node; a run of one is hashed as well, and a lone leaf is its own subroot.

Defined cases: null fields are ``-`` in a leaf, so a null differs from an empty text; rows without source are a
source of their own, the first; rows without doc_id come first in their source; rows with equal
doc_id are ordered by their leaves, so repeated rows are leaves of their own and which of two equal ones is which makes no difference. Very long texts are
hashed whole in Spark. Columns other than those of the leaf are not looked at, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchlens.llm import scratch

ARITY = 3
#: Levels of a stage, and of a block; a block has ARITY ** LEVELS leaves.
STEP, LEVELS = 2, 6
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The hex digest of a row's fields, each with its length."""
    parts = []
    for c in fields.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root that a leaf and its path (its place in each run, and the run's others) lead to."""

    def up(node: Column, step: Column) -> Column:
        at, others = step["0"], step["1"]
        return F.sha2(F.concat(F.array_join(F.slice(others, F.lit(1), at), ""), node, F.array_join(F.slice(others, at + 1, F.lit(ARITY)), "")), 256)

    return F.aggregate(F.arrays_zip(places.alias("0"), siblings.alias("1")), leaf, up)


def _hash(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def _lasts(n: int) -> list[int]:
    """The index of the last node of each level over n leaves, up to the level of one node."""
    out = [n - 1]
    while out[-1]:
        out.append(out[-1] // ARITY)
    return out


class _Subtree:
    """The nodes of levels ``bottom`` to ``top`` below node ``index`` of level ``top``, hashed from leaves that come one by one."""

    def __init__(self, lasts: list[int], bottom: int, top: int, index: int):
        self.lasts, self.bottom, self.top = lasts, bottom, top
        self.next, self.end = index * ARITY**top, min(lasts[0] + 1, (index + 1) * ARITY**top)
        self.runs: list[list[bytes]] = [[] for _ in range(top)]
        self.kept: dict[tuple[int, int], bytes] = {}

    def add(self, leaf: bytes) -> None:
        node, at, level = leaf, self.next, 0
        self.next += 1
        while True:
            if level >= self.bottom:
                self.kept[level, at] = node
            if level == self.top:
                return
            run = self.runs[level]
            run.append(node)
            if len(run) < ARITY and at < self.lasts[level]:
                return
            node, at, level = _hash(run), at // ARITY, level + 1
            run.clear()


def _grown(lasts: list[int], bottom: int, top: int, index: int, leaf: Callable[[int], bytes]) -> _Subtree:
    tree = _Subtree(lasts, bottom, top, index)
    while tree.next < tree.end:
        tree.add(leaf(tree.next))
    return tree


def root_of(leaf: Callable[[int], bytes], n: int, height: int) -> bytes:
    """The node at ``height`` above all n leaves."""
    lasts = _lasts(n)
    lasts += [0] * (height + 1 - len(lasts))
    return _grown(lasts, height, height, 0, leaf).kept[height, 0]


def traversal(leaf: Callable[[int], bytes], n: int, height: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """The authentication path of leaf 0, 1, ... up to ``height``: for each level the place in the run and the run's others."""
    lasts = _lasts(n)
    lasts += [0] * (height + 1 - len(lasts))
    stages = [(low, min(low + STEP, height)) for low in range(0, height, STEP)]

    def desired(low: int, top: int, index: int) -> _Subtree | None:
        return _Subtree(lasts, low, top, index) if index <= lasts[top] else None

    existing = [_grown(lasts, low, top, 0, leaf) for low, top in stages]
    coming = [desired(low, top, 1) for low, top in stages]
    places, others = [0] * height, [[]] * height
    for i in range(n):
        at = i
        for level in range(height):  # the siblings of a level change when the walk enters another node of it
            if i % ARITY**level:
                break
            tree, place = existing[level // STEP].kept, at % ARITY
            first = at - place
            places[level], others[level] = place, [tree[level, j] for j in range(first, min(first + ARITY - 1, lasts[level]) + 1) if j != at]
            at //= ARITY
        yield list(places), list(others)
        for s, (low, top) in enumerate(stages):
            tree = coming[s]
            if tree and tree.next < tree.end:
                tree.add(leaf(tree.next))
            if (i + 1) % ARITY**top == 0 and tree:
                existing[s], coming[s] = tree, desired(low, top, (i + 1) // ARITY**top + 1)


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with pos (from 0, in ``order`` within grp) and n (rows of the grp)."""
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranged = scratch.saved(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    runs = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))  # a row for each partition and its groups
    own = Window.partitionBy("grp")
    runs = runs.select("grp", "part", (F.sum("m").over(own.orderBy("part")) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"))
    return ranged.join(runs, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _height(n: int) -> int:
    """Levels of a block of a tree over n nodes."""
    return LEVELS if n > BLOCK else len(_lasts(n)) - 1


def _rounds(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of ``nodes`` (grp, pos, n, digest, item), then of their roots, up to one block a grp; and grp, digest of the tops."""

    def roots(batches):
        for batch in batches:
            out = []
            for i, n in enumerate(batch.column("n").to_pylist()):
                own = [x.hex().encode() for x in batch.column("nodes")[i].values.field("digest").to_pylist()]
                out.append(bytes.fromhex(root_of(own.__getitem__, len(own), _height(n)).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("n"), pa.array(out, pa.binary())], ["grp", "block", "n", "digest"])

    rounds = []
    while True:
        node = F.struct("pos", "digest", *(["item"] if not rounds else []))
        grouped = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(node)).alias("nodes"))
        rounds.append(scratch.saved(grouped, name))
        tops = rounds[-1].select("grp", "block", "n", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes"))
        tops = scratch.saved(tops.mapInArrow(roots, "grp string, block long, n long, digest binary"), name)
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return rounds, tops.select("grp", "digest")
        nodes = tops.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "digest")


_UPPER = ["subroot", "root", "up_places", "up_siblings"]


def _paths(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """grp, block (the node's position), leaf, item, subroot, root, up_places, up_siblings: the whole path of every node of the blocks.

    ``upper`` has each block's own path and what else all its nodes share.
    """
    met = blocks.join(upper, ["grp", "block"])
    item = {f.name: f.dataType for f in blocks.schema["nodes"].dataType.elementType.fields}.get("item")
    has = item is not None

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                nodes = batch.column("nodes")[i].values
                own = [x.hex().encode() for x in nodes.field("digest").to_pylist()]
                up_places, up_others = batch.column("up_places")[i].as_py(), batch.column("up_siblings")[i].as_py()
                places, others = [], []
                for p, o in traversal(own.__getitem__, len(own), _height(batch.column("n")[i].as_py())):
                    places.append(p + up_places)
                    others.append([[x.decode() for x in run] for run in o] + up_others)
                same = [pa.array([batch.column(c)[i].as_py()] * len(own), pa.string()) for c in ("grp", "subroot", "root")]
                columns = [same[0], nodes.field("pos"), pa.array([x.decode() for x in own], pa.string()), *same[1:], pa.array(places, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns + ([nodes.field("item")] if has else []), ["grp", "block", "leaf", *_UPPER, *["item"] * has])

    kind = "grp string, block long, leaf string, subroot string, root string, up_places array<int>, up_siblings array<array<string>>"
    return met.mapInArrow(run, kind + (f", item {item.simpleString()}" if has else ""))


def _descended(rounds: list[DataFrame], upper: DataFrame) -> DataFrame:
    for blocks in reversed(rounds):
        upper = _paths(blocks, upper.select("grp", "block", *_UPPER))
    return upper


def with_proofs(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, leaf, and others that are kept) with subroot, root, and the path of each leaf as places and siblings."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # without a source first; otherwise bytewise
    nodes = leaves.select(key.alias("grp"), F.col("doc_id").alias("id"), F.unhex("leaf").alias("digest"), F.struct(*(F.col(c) for c in leaves.columns if c != "leaf")).alias("item"))
    rounds, subroots = _rounds(_numbered(nodes, "leaves", "id", "digest").drop("id"), "blocks")
    sources = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.struct(F.col("grp").alias("key")).alias("item"))
    above, top = _rounds(_numbered(sources, "subroots", "key").drop("key"), "sources")
    none = F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"), F.array().cast("array<int>").alias("up_places"), F.array().cast("array<array<string>>").alias("up_siblings")
    upper = _descended(above, top.select("grp", F.lit(0).cast("long").alias("block"), *none))
    upper = scratch.saved(upper.select(F.col("item.key").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("leaf").alias("subroot"), *_UPPER[1:]), "proofs")
    out = _descended(rounds, upper)
    return out.select("item.*", "leaf", "subroot", "root", F.col("up_places").alias("places"), F.col("up_siblings").alias("siblings"))


def manifest(docs: DataFrame, **others: Column) -> DataFrame:
    """doc_id, source, leaf, subroot, root, places, siblings of every row of ``docs``; ``others`` are columns of it to keep."""
    fields = {c: F.col(c) for c in FIELDS}
    return with_proofs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(fields).alias("leaf"), *(c.alias(name) for name, c in others.items())))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; of half the rows the newlines of the text go, which their proofs must show."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = {c: F.col(c) for c in FIELDS} | {"text": F.translate("text", "\n", "")}
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.unhex(leaf_digest(changed)))
    proofs = manifest(docs, now=now)
    back = folded(F.coalesce(F.lower(F.hex("now")), F.col("leaf")), F.col("places"), F.col("siblings"))
    proofs = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.flatten("siblings"), ""), 256).alias("proof_sha256"), back.alias("folded_root"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(cast(strlen(cast({0} as varchar)) as varchar) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256({})"

#: Levels are a recursion; crc32 is one too, bit by bit.
ORACLE_SQL = f"""
with recursive d as (select *, cast(doc_id as varchar) as id from documents),
c as (select *, list_reduce(list_prepend(4294967295, list_transform(range(1, length(id) + 1), lambda i: cast(ord(id[i]) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) as crc from d),
f as (select row_number() over () as row, coalesce('=' || source, '') as grp, doc_id, {_LEAF.format(" || ".join(_FIELD.format(c) for c in FIELDS))} as leaf,
  case when xor(crc, 4294967295) % 2 = 0 then {_LEAF.format(" || ".join(_FIELD.format(c if c != "text" else "replace(text, chr(10), '')") for c in FIELDS))} end as changed from c),
l as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from f),
t(level, grp, pos, h, n) as (
  select 0, grp, pos, leaf, count(*) over (partition by grp) from l
  union all
  select level + 1, grp, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from t where n > 1 group by level, grp, pos // 3, n),
s as (select grp, h as subroot, row_number() over (order by grp) - 1 as place, level as high from t where n = 1),
u(level, pos, h, n) as (
  select 0, place, subroot, count(*) over () from s
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from u where n > 1 group by level, pos // 3, n),
e as (
  select l.row, t.level, string_agg(t.h, '' order by t.pos) filter (t.pos < l.pos // pow(3, t.level)::bigint) as l, string_agg(t.h, '' order by t.pos) filter (t.pos > l.pos // pow(3, t.level)::bigint) as r
  from l join s using (grp) join t on t.grp = l.grp and t.level < s.high and t.pos // 3 = l.pos // pow(3, t.level + 1)::bigint group by l.row, t.level
  union all
  select l.row, s.high + u.level, string_agg(u.h, '' order by u.pos) filter (u.pos < s.place // pow(3, u.level)::bigint), string_agg(u.h, '' order by u.pos) filter (u.pos > s.place // pow(3, u.level)::bigint)
  from l join s using (grp) join u on u.n > 1 and u.pos // 3 = s.place // pow(3, u.level + 1)::bigint group by l.row, s.high + u.level),
p as (select row, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' order by level)) as proof_sha256 from e group by row),
b(row, level, h) as (
  select row, 0, coalesce(changed, leaf) from l
  union all
  select b.row, b.level + 1, sha256(coalesce(e.l, '') || b.h || coalesce(e.r, '')) from b join e on e.row = b.row and e.level = b.level),
k as (select row, max_by(h, level) as folded_root from b group by row)
select l.doc_id, l.leaf, s.subroot, u.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, k.folded_root, k.folded_root = u.h as verified
from l join s using (grp) join k on k.row = l.row left join p on p.row = l.row cross join (select h from u where n = 1) u
"""
