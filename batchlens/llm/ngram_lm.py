"""A trigram language model in Elias-Fano tries, trained and queried by Spark tasks.

``train`` counts every word and every n-gram of the training texts. Level 1 has the words' hashes and
counts. The n-grams go to shards by their first word (a word with much of the corpus is split
by its second word), and each shard is one trie: nodes (first words), their successors, and
the successors' successors. Values below a context are kept relative to the context
(context number * 2**32 + a 32-bit hash of the word), so each level is one monotone sequence, searched by
successor search and bounded by the context's monotone pointers, all in Elias-Fano form. Next to
each value stands its discounted probability, next to each context its back-off weight, as 8-bit codes
on a logarithmic scale. Tasks that score memory-map one shard at a time, so their memory
doesn't grow with the model.

The model: p(c|ab) = f(abc) + l(ab) p(c|b), p(c|b) = f(bc) + l(b) p(c), absolute discounting at both
orders, p(c) = (count + 0.5) / (N + 0.5 (V + 1)). Texts start with a mark that is context only and end with an end token.

Null and empty texts are the end token alone. Rows that repeat are scored (and learned) each. A null
doc_id counts as a training row. Without training text every token has p(c) alone. A slice holds about 2 MB of
texts, or one longer text whole. Columns other than doc_id and text are not looked at, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch
from batchlens.llm.eliasfano import EliasFano, build, pack_arrays, unpack_arrays
from batchlens.llm.words import mix, sliced, word_hashes

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
DISCOUNT = 0.75
_CHUNK = 1 << 20
_PACKED = 21
_WORDS_A_SHARD = 2 << 20
_LOWEST = -9.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.concatenate([[0.0], 10.0 ** np.linspace(_LOWEST, 0, 255)])


def _code(p: np.ndarray) -> np.ndarray:
    """Probabilities as 8-bit codes: 0 for none, else the nearest of 255 steps of a logarithmic scale."""
    step = np.rint((np.log10(np.maximum(p, 1e-300)) - _LOWEST) / -_LOWEST * 254) + 1
    return np.where(p > 0, np.clip(step, 1, 255), 0).astype(np.uint8)


def _short(h: np.ndarray) -> np.ndarray:
    """The 32-bit hash of a word (never 0, which stands for no word)."""
    return np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def _spread(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _by_shard(shard: np.ndarray):
    """Each shard that occurs, and where."""
    order = np.argsort(shard, kind="stable")
    first = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(first, [*first[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def _streams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens one after the other, each text between START and END; where each text begins."""
    counts = np.diff(bounds)
    begins = np.concatenate([[0], np.cumsum(counts + 2)])
    out = np.empty(int(begins[-1]), np.uint64)
    out[begins[:-1]] = START
    out[begins[1:] - 1] = END
    out[np.arange(len(words)) + np.repeat(2 * np.arange(len(counts)) + 1, counts)] = words
    return out, begins


def _chunks(batches, text: str = "text"):
    """Batches of about _CHUNK tokens: the rows, the stream, and where each row's text begins in it."""
    held, parts, n = [], [], 0
    for batch in sliced(batches, text, 2 << 20):
        words, bounds = word_hashes(batch.column(text))
        held.append(batch)
        parts.append(_streams(words, bounds))
        n += len(parts[-1][0])
        if n >= _CHUNK:
            yield _joined(held, parts)
            held, parts, n = [], [], 0
    if held:
        yield _joined(held, parts)


def _joined(held, parts):
    shift = np.cumsum([0, *(len(s) for s, _ in parts)])
    begins = np.concatenate([b[:-1] + k for (_, b), k in zip(parts, shift)] + [shift[-1:]])
    return held, np.concatenate([s for s, _ in parts]), begins


class Model:
    """Where the files of a trained model are, and the few numbers that hold for all of it."""

    def __init__(self, path: str, shards: int, tokens: int, distinct: int, parts: int, heavy: np.ndarray, splits: np.ndarray, backoff: np.ndarray):
        self.path, self.shards, self.tokens, self.distinct, self.parts = path, shards, tokens, distinct, parts
        #: Words whose n-grams are split, into how many nodes, and their back-off weights; at most 4 a shard.
        self.heavy, self.splits, self.backoff = heavy, splits, backoff
        self.floor = tokens + 0.5 * (distinct + 1)

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        """The training counts of word hashes."""
        out, shard = np.zeros(len(words), np.int64), _spread(words, self.shards)
        for s, own in _by_shard(shard):
            arrays = unpack_arrays(scratch.mapped(f"{self.path}/words-{s}"))
            at, same = EliasFano(arrays[:4]).successor(words[own])
            out[own[same]] = arrays[4][at[same]]
        return out

    def node(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The node's hash for n-grams that begin with these two words."""
        if not len(self.heavy):
            return first
        at = np.minimum(np.searchsorted(self.heavy, first), len(self.heavy) - 1)
        split = np.where(self.heavy[at] == first, self.splits[at], 1).astype(np.uint64)
        return np.where(split > 1, mix(first + (_short(second) % split + np.uint64(1)) * _ODD), first)

    def ngrams(self, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        """For n-grams (a, b, c): f(b|a), l(a), f(c|ab), l(ab) as probabilities and weights."""
        node = self.node(a, b)
        f2, l2, f3, l3 = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(a)), np.ones(len(a))
        for s, own in _by_shard(_spread(node, self.parts)):
            arrays = unpack_arrays(scratch.mapped(f"{self.path}/ngrams-{s}"))
            nodes, pointers, pairs, pair_pointers, triples = (EliasFano(arrays[4 * i : 4 * i + 4]) for i in range(5))
            back, pair_code, pair_back, triple_code = arrays[20:24]
            at, same = nodes.successor(node[own])
            own, at = own[same], at[same]
            l2[own] = _CODES[back[at]]
            place, found = _below(pairs, pointers, at, _short(b[own]))
            own, at = own[found], place[found]
            f2[own], l3[own] = _CODES[pair_code[at]], _CODES[pair_back[at]]
            place, found = _below(triples, pair_pointers, at, _short(c[own]))
            f3[own[found]] = _CODES[triple_code[place[found]]]
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, a), len(self.heavy) - 1)
            l2 = np.where(self.heavy[at] == a, self.backoff[at], l2)
        return f2, l2, f3, l3


def _below(values: EliasFano, pointers: EliasFano, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Search words among the successors of contexts: within the context's pointers, relative to the context."""
    begin, end = pointers.access(context), pointers.access(context + 1)
    some = np.flatnonzero(begin < end)
    place, same = values.successor((context[some].astype(np.uint64) << np.uint64(32)) | word[some])
    same &= (place >= begin[some]) & (place < end[some])
    out, found = np.zeros(len(context), np.int64), np.zeros(len(context), bool)
    out[some], found[some] = place, same
    return out, found


def _count_words(training: DataFrame, path: str, shards: int) -> DataFrame:
    """Write the words' files; total, size, and the frequent words of each shard with words."""
    def count(batches):
        for _, stream, _ in _chunks(batches):
            words, n = np.unique(stream[stream != START], return_counts=True)
            some = list(_by_shard(_spread(words, shards)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in some], pa.int32()), *(pa.array([x[own].astype(t).tobytes() for _, own in some], pa.binary()) for x, t in ((words, "<u8"), (n, "<u4")))],
                ["shard", "words", "n"],
            )

    def write(batches):
        held = defaultdict(list)
        for batch in batches:
            for s, w, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "n"))):
                held[s] += [(w, n)] * (w is not None)
        for s, got in held.items():
            if not got:
                scratch.put_bytes(f"{path}/words-{s}", pack_arrays([*build(np.zeros(0, np.uint64)), np.zeros(0, "<u8")]))
                continue
            words, n = (np.concatenate([np.frombuffer(x[i], t) for x in got]) for i, t in ((0, "<u8"), (1, "<u4")))
            order = np.argsort(words)
            first = np.flatnonzero(np.diff(words[order], prepend=words[order[:1]] + np.uint64(1)))
            words, n = words[order][first], np.add.reduceat(n[order].astype(np.int64), first)
            scratch.put_bytes(f"{path}/words-{s}", pack_arrays([*build(words), n.astype("<u8")]))
            top = np.flatnonzero(n >= max(1, min(_WORDS_A_SHARD // 2, n.sum() // 64)))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((s, pa.int32()), (int(n.sum()), pa.int64()), (len(n), pa.int64()), (words[top].view(np.int64), pa.list_(pa.int64())), (n[top], pa.list_(pa.int64())))], ["shard", "total", "size", "words", "n"])

    every = training.sparkSession.range(shards).selectExpr("cast(id as int) as shard", "cast(null as binary) as words", "cast(null as binary) as n")  # a file for each shard
    blobs = training.select("text").mapInArrow(count, "shard int, words binary, n binary").union(every)
    return scratch.saved(blobs.repartition(shards, "shard").mapInArrow(write, "shard int, total long, size long, words array<long>, n array<long>"), "ngram-words")


def _distinct(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples of word numbers and how often each occurs; in one integer where the numbers have at most _PACKED bits."""
    if max(x.max(initial=0) for x in (a, b, c)) < 1 << _PACKED:
        shift, mask = np.uint64(_PACKED), np.uint64((1 << _PACKED) - 1)
        key, n = np.unique((((a.astype(np.uint64) << shift) | b.astype(np.uint64)) << shift) | c.astype(np.uint64), return_counts=True)
        return *((x & mask).astype(np.int64) for x in (key >> shift >> shift, key >> shift, key)), n
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    return a[first], b[first], c[first], np.diff(np.append(first, len(a)))


def _events(model: Model, stream: np.ndarray, begins: np.ndarray):
    """The chunk's n-grams (a, b, c; c may be none) with their counts, by shard."""
    words, ids = np.unique(stream, return_inverse=True)
    last = np.zeros(len(stream), bool)
    last[begins[1:] - 1] = True
    i = np.flatnonzero(~last)
    third = np.where(last[i + 1], 0, ids[np.minimum(i + 2, len(ids) - 1)] + 1)
    a, b, c, n = _distinct(ids[i], ids[i + 1], third)
    a, b = words[a], words[b]
    node = model.node(a, b)
    short = np.concatenate([np.zeros(1, np.uint32), _short(words)])
    return node, _short(b), short[c], n.astype(np.uint32)


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _trie(ngrams: list[np.ndarray], total_of) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of one shard's trie from its n-grams (node, b, c, counts) in any order, which are taken out of the list; the nodes and how many successors each has."""
    node, b, c, n = ngrams
    ngrams.clear()
    nodes, at = np.unique(node, return_inverse=True)
    del node
    pair = (at.astype(np.uint64) << np.uint64(32)) | b
    del at, b
    order = np.lexsort((c, pair))
    pair, c, n = pair[order], c[order], n[order].astype(np.float64)
    del order
    pair_first = _runs(pair)
    pair_values = pair[pair_first]
    pair_n = np.add.reduceat(n, pair_first)
    owner = (pair_values >> np.uint64(32)).astype(np.int64)
    node_pairs = np.bincount(owner, minlength=len(nodes))
    node_total = np.maximum(total_of(nodes, np.bincount(owner, weights=pair_n, minlength=len(nodes))), 1)
    rank = np.repeat(np.arange(len(pair_first)), np.diff(np.append(pair_first, len(pair))))
    triple = (rank.astype(np.uint64) << np.uint64(32)) | c
    keep = c > 0
    triple, m = triple[keep], n[keep]
    del rank, keep, pair, c, n
    first = _runs(triple) if len(triple) else np.zeros(0, np.int64)
    values = triple[first]
    triple_n = np.add.reduceat(m, first) if len(first) else m
    context = (values >> np.uint64(32)).astype(np.int64)
    seen = np.bincount(context, weights=triple_n, minlength=len(pair_values))
    kinds = np.bincount(context, minlength=len(pair_values))
    pointers = lambda counts: np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
    arrays = [*build(nodes), *build(pointers(node_pairs)), *build(pair_values), *build(pointers(kinds)), *build(values)]
    arrays.append(_code(DISCOUNT * node_pairs / node_total))
    arrays.append(_code((pair_n - DISCOUNT) / node_total[owner]))
    arrays.append(np.where(seen > 0, _code(DISCOUNT * kinds / np.maximum(seen, 1)), 255).astype(np.uint8))
    arrays.append(_code((triple_n - DISCOUNT) / seen[context]))
    return arrays, nodes, node_pairs


def train(training: DataFrame) -> Model:
    """Train on the column ``text`` of all rows."""
    spark = training.sparkSession
    path = scratch.new_path(spark, "ngram-lm")
    shards = max(12, (training.agg(F.sum(F.length("text"))).first()[0] or 0) // (16 << 20))
    done = _count_words(training, path, shards)
    tokens, distinct = (x or 0 for x in done.agg(F.sum("total"), F.sum("size")).first())
    parts = max(12, tokens // _WORDS_A_SHARD)
    most = max(1, tokens // (2 * parts))
    frequent = done.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select("x.*").where(F.col("n") > most)
    top = {r["words"] & (2**64 - 1): r["n"] for r in frequent.collect()}
    texts = training.count() if tokens else 0
    if texts > most:
        top[int(START)] = texts
    heavy = np.array(sorted(top), np.uint64)
    counts = np.array([top[int(w)] for w in heavy], np.int64)
    splits = -(-counts // most)
    model = Model(path, shards, tokens, distinct, parts, heavy, splits, np.ones(len(heavy)))
    virtual = {}
    for w, k, n in zip(heavy, splits.tolist(), counts.tolist()):
        if k > 1:
            virtual |= {int(x): (int(w), n) for x in mix(np.array([w], np.uint64) + (np.arange(k, dtype=np.uint64) + np.uint64(1)) * _ODD)}

    def emit(batches):
        for _, stream, begins in _chunks(batches):
            node, b, c, n = _events(model, stream, begins)
            some, blobs = [], []
            for s, own in _by_shard(_spread(node, parts)):
                some.append(s)
                first = _runs(node[own])
                length = np.diff(np.append(first, len(own))).astype("<u4")
                raw = b"".join(pack_arrays([node[own][first], length, b[own], c[own], n[own]]))
                blobs.append(np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "ngrams"])

    known = np.array(sorted(virtual), np.uint64)
    known_total = np.array([virtual[int(x)][1] for x in known], np.float64)

    def total_of(nodes, own):
        if not len(known):
            return own
        at = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
        return np.where(known[at] == nodes, known_total[at], own)

    def write(batches):
        held = defaultdict(list)
        for batch in batches:
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("ngrams").to_pylist()):
                held[s] += [raw] * (raw is not None)
        for s in list(held):
            got = []
            if not held[s]:
                none = np.zeros(0, np.uint64)
                scratch.put_bytes(f"{path}/ngrams-{s}", pack_arrays([*build(none), *build(np.zeros(1, np.uint64)), *build(none), *build(np.zeros(1, np.uint64)), *build(none), *[np.zeros(0, np.uint8)] * 4]))
                continue
            for raw in held.pop(s):
                whole = pa.decompress(raw[8:], decompressed_size=int(np.frombuffer(raw[:8], "<i8")[0]), codec="zstd", asbytes=True)
                node, length, b, c, n = unpack_arrays(np.frombuffer(whole, np.uint8))
                got.append((np.repeat(node, length), b, c, n))
            joined = [np.concatenate(x) for x in zip(*got)]
            got = whole = node = length = b = c = n = None  # a shard's parts and its joined arrays needn't be there at once
            arrays, nodes, size = _trie(joined, total_of)
            scratch.put_bytes(f"{path}/ngrams-{s}", pack_arrays(arrays))
            split = np.isin(nodes, known)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([nodes[split].view(np.int64)], pa.list_(pa.int64())), pa.array([size[split]], pa.list_(pa.int64()))], ["shard", "nodes", "sizes"])

    every = spark.range(parts).selectExpr("cast(id as int) as shard", "cast(null as binary) as ngrams")  # a file for each shard
    blobs = training.select("text").mapInArrow(emit, "shard int, ngrams binary").union(every).repartition(parts, "shard")
    split_nodes = blobs.mapInArrow(write, "shard int, nodes array<long>, sizes array<long>").where(F.size("nodes") > 0)
    kinds: dict[int, int] = defaultdict(int)
    for r in split_nodes.collect():
        for node, size in zip(r["nodes"], r["sizes"]):
            kinds[virtual[node & (2**64 - 1)][0]] += size
    keep = splits > 1
    model.heavy, model.splits = heavy[keep], splits[keep]
    model.backoff = np.array([DISCOUNT * kinds[int(w)] / n for w, n in zip(heavy[keep], counts[keep])])
    return model


def _text_scores(model: Model, stream: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Of each text: tokens, tokens known, log10 of the base and of the model's probability."""
    words, ids = np.unique(stream, return_inverse=True)
    counts = model.word_counts(words)
    p1 = ((counts + 0.5) / model.floor)[ids] if model.floor else np.ones(len(ids))
    last = np.zeros(len(stream), bool)
    last[begins[1:] - 1] = True
    i = np.flatnonzero(~last)
    c = np.where(last[i + 1], np.uint64(0), stream[np.minimum(i + 2, len(stream) - 1)])
    f2, l2, f3, l3 = model.ngrams(stream[i], stream[i + 1], c)
    p2 = f2 + l2 * p1[i + 1]
    p = p2.copy()
    inner = np.flatnonzero(~last[i[1:] - 1] & (i[1:] - 1 == i[:-1])) + 1
    p[inner] = f3[inner - 1] + l3[inner - 1] * p2[inner]
    cuts = begins - np.arange(len(begins))
    sums = lambda x: np.add.reduceat(x, cuts[:-1]) if len(cuts) > 1 else x[:0]
    known = counts[ids][i + 1] > 0
    return [np.diff(cuts), sums(known.astype(np.int64)), sums(np.log10(p1[i + 1])), sums(np.log10(np.minimum(p, 1.0)))]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for held, stream, begins in _chunks(batches):
            n, known, base, score = _text_scores(model, stream, begins)
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score)], names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return scored(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
