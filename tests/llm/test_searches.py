"""The searching and scoring operators against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.llm import ann, decontam, jaccard_join, ngram_lm, quality
from batchlens.llm.components import components

DOCS = "doc_id long, text string"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed, n=160, vocabulary=60):
    """Texts with exact and near copies of all sizes, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % vocabulary}x{rng.randrange(40)}"
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = [word() for _ in range(rng.randrange(0, 90))]
        if rows and kind < 0.4:
            text = split(rng.choice(rows)[1])
            for _ in range(rng.randrange(0, 4)):
                if text:
                    text[rng.randrange(len(text))] = word()
        elif kind < 0.55:
            text = text[:40] + passage + text[40:]
        rows.append((i, " ".join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE\ttwo")]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_jaccard_join(spark, k, percent, seed):
    rows = corpus(seed)
    sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := split(t)) else frozenset() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_documents(spark.createDataFrame(rows, DOCS).repartition(3), k, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join_of_short_texts(spark):
    """Pairs of exactly 0.8 whose lists have a third text, with the same passage, as centre."""
    assert all(jaccard_join._prefixes(np.arange(n, dtype=np.uint64), np.full(n, t), p)[1] <= -(-p * n // 100) for n in range(1, 12) for t in (2, 4, 50) for p in (1, 60, 80, 90))
    rows, texts, rng = [], {}, random.Random(9)
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(8 + g % 3)]
        tail = [f"tail{g % 6}x{i}" for i in range(12)]
        for text in (words + tail, words[:-1], words, tail, tail + ["end"]) if g % 2 else (words + tail, words, words[1:], words, tail, tail):
            texts[len(rows)] = text
            rows.append((len(rows), " ".join(text)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in texts.items()}
    part = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and part[i] != part[j]:
                lo, hi = sorted((part[i], part[j]))
                part = {d: lo if p == hi else p for d, p in part.items()}
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], DOCS + ", own long")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked_documents(docs, 5, 80, "own").select("doc_id", "component_id").collect()}
    assert {i: (got[i], part[i]) for i in part if got[i] != part[i]} == {}


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "other words here to stay now", "x"), (3, None, "x"), (4, "", "x")]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, DOCS + ", key string")).collect()
    assert sorted((r["doc_id"], r["key"] in "xy") for r in got) == [(1, True), (2, True), (3, True), (4, True)]
    assert jaccard_join.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 99), (7, 7)] + [(5, 40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in [5, *range(10, 41)]}, 99: 99, 100: 99, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model(spark):
    ngram_lm._WORDS_A_SHARD, before = 40, ngram_lm._WORDS_A_SHARD
    rows = corpus(4, n=120) + [(None, "null id")]
    model_docs = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for _, t in model_docs:
        s = ["<s>", *split(t), "</s>"]
        c1.update(s[1:])
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    total, floor, d = sum(c1.values()), sum(c1.values()) + 0.5 * (len(c1) + 1), ngram_lm.DISCOUNT
    t2, k2, t3, k3 = Counter(), Counter(), Counter(), Counter()
    for (a, _), n in c2.items():
        t2[a] += n
        k2[a] += 1
    for (a, b, _), n in c3.items():
        t3[a, b] += n
        k3[a, b] += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = ngram_lm.train(docs.where(~ngram_lm.held_out(F.col("doc_id"))))
    ngram_lm._WORDS_A_SHARD = before
    assert len(model.heavy) and model.tokens == total and model.distinct == len(c1)
    texts = dict(rows)
    for r in ngram_lm.scored(docs, model).collect():
        s = ["<s>", *split(texts[r["doc_id"]]), "</s>"]
        base = score = 0.0
        for i in range(1, len(s)):
            a, p = s[i - 1], (c1[s[i]] + 0.5) / floor
            base += math.log10(p)
            if t2[a]:
                p = (max(c2[a, s[i]] - d, 0) + d * k2[a] * p) / t2[a]
            if i > 1 and t3[s[i - 2], a]:
                p = (max(c3[s[i - 2], a, s[i]] - d, 0) + d * k3[s[i - 2], a] * p) / t3[s[i - 2], a]
            score += math.log10(p)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s) - 1, sum(c1[w] > 0 for w in s[1:]), total)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base)) and abs(r["score"] - score) < 0.04 * len(s)  # 8-bit codes
    empty = ngram_lm.train(spark.createDataFrame([], DOCS))
    assert ngram_lm.scored(docs, empty).count() == len(rows) and ngram_lm.scored(spark.createDataFrame([], DOCS), empty).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got["quality"] == got["predicted"]).mean() > 0.97) and got["score"].between(0, 1).all()
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "###", "c")], DOCS + ", score string")
    out = quality.accepted(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and out.count() == 3


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(500)}" for _ in range(rng.choice([3, 14, 20, 33])))) for i in range(25)] + [(25, ""), (26, None)]
    docs = []
    for i in range(120):
        words = [f"d{rng.randrange(900)}" for _ in range(rng.randrange(0, 60))]
        if i % 3:
            own = split(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words) + 1)
            words = words[:at] + ([w.upper() + "," for w in own] if i % 2 else own) + words[at:]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, "")]
    shingles = lambda w: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    expected = {}
    for d, text in docs:
        w = plain(text)
        for i, item in items:
            q = plain(item)
            if not q or not w:
                continue
            n, best = min(len(q), len(w)), 0.0
            for s in range(len(w) - n + 1):
                a, b = shingles(w[s : s + n]), shingles(q)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                expected[d, i] = best
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() <= expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert {k for k, v in expected.items() if v > 0.85} <= got.keys() and len(got) >= 0.97 * len(expected)
    kept = decontam.uncontaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_multi_index_finds_all_within_the_radius():
    index = decontam.Index(list(range(40)), [" ".join(f"{i}q{j}" for j in range(12)) for i in range(40)], 5)
    rng = np.random.default_rng(5)
    prints = np.array([int(index.prints[i % 40]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for i in range(400)], np.uint64)
    w, i = index.near(prints)
    far = np.bitwise_count(prints[:, None] ^ index.prints[None, :])
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS))))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] + [1.0] * 15), (1400, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        assert [g[0] for g in got[q]] == list(range(1, 11)) and all(abs(d[g[1]] - g[2]) < 1e-12 for g in got[q])
        hits += len({g[1] for g in got[q]} & set(order))
        if q == 100:
            assert [g[1] for g in got[q]] == order
    assert hits >= 0.9 * 70 and set(got) == set(range(0, 700, 100))
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2


def test_words_beyond_the_packed_bits():
    rng = np.random.default_rng(8)
    a, b, c = (rng.integers(0, 30, 4000) for _ in range(3))
    packed = ngram_lm._distinct(a, b, c)
    before, ngram_lm._PACKED = ngram_lm._PACKED, 3
    wide = ngram_lm._distinct(a, b, c)
    ngram_lm._PACKED = before
    assert Counter(zip(a.tolist(), b.tolist(), c.tolist())) == dict(zip(zip(*(x.tolist() for x in wide[:3])), wide[3].tolist()))
    assert all((x == y).all() for x, y in zip(packed, wide))


def test_quality_votes():
    """Features and votes against plain Python."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta", "x1", "gamma!", "12", "a  b"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", None]
    before, quality.BYTES = quality.BYTES, 97  # blocks end inside of texts
    x = quality.features(pa.array(texts, pa.string()))
    quality.BYTES = before
    assert np.allclose(x, quality.features(pa.array(texts, pa.string()))) and not x[-2:].any()
    assert np.allclose((x[:60, : quality.WORDS] ** 2).sum(axis=1), 1, atol=1e-3)
    some = [np.flatnonzero(r) for r in x[:40]]
    rows = quality.Sparse([(i.astype("<u2").tobytes(), r[i].astype("<f2").tobytes()) for i, r in zip(some, x)])
    voters = quality.Voters(rows, np.array([float(i % 3 > 0) for i in range(40)]))
    got = voters.scores(x)
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    for i in range(len(texts)):
        v = unit((x[i].astype(float) * voters.weight) @ voters.axes)
        cosine = sorted(((float(v @ unit(w.astype(float))), float(label)) for w, label in zip(voters.vectors, voters.labels)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0) ** 8 for c, _ in cosine]
        assert abs(got[i] - (sum(w * label for w, (_, label) in zip(weight, cosine)) / sum(weight) if v.any() else voters.prior)) < 1e-3


def test_decontamination_of_long_texts_and_empty_tables(spark):
    """An item at the start, at the end and across the edges of spans of a long text; several index files; a clashing column."""
    rng = random.Random(7)
    items = [(i, " ".join(f"b{i}x{rng.randrange(500)}" for _ in range(30))) for i in range(6)]
    words = [f"d{rng.randrange(9000)}" for _ in range(60_000)]
    for i, at in enumerate((0, decontam.SPAN - 12, 2 * decontam.SPAN - 1, 3 * decontam.SPAN + 5, 59_970)):
        words[at : at + 30] = items[i][1].split()
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (2, "short text", "b"), (None, None, None)], DOCS + ", similarity string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    before, decontam.MOST_ITEM_BYTES = decontam.MOST_ITEM_BYTES, 400
    got = {(r["doc_id"], r["item_id"]): r["first_word"] for r in decontam.contaminated(docs, benchmark).collect()}
    kept = decontam.uncontaminated(docs, benchmark)
    decontam.MOST_ITEM_BYTES = before
    assert got == {(1, 0): 0, (1, 1): decontam.SPAN - 12, (1, 2): 2 * decontam.SPAN - 1, (1, 3): 3 * decontam.SPAN + 5, (1, 4): 59_970}
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2] and kept.columns == docs.columns
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0 and decontam.contaminated(docs, benchmark.limit(0)).count() == 0 and decontam.uncontaminated(docs, benchmark.limit(0)).count() == 3


def test_long_lists_are_split(spark):
    before, jaccard_join.SPLIT = jaccard_join.SPLIT, 3
    test_jaccard_join(spark, 3, 90, 11)
    jaccard_join.SPLIT = before


def test_neighbours_of_doubles_and_of_repeated_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)) * 1e-9 + 1  # equal in single precision
    x[200:] = 2.0
    ids = [*range(200), *[200] * 25, *range(201, 276)]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 100):
        d = np.sqrt(((x[:200] - x[q]) ** 2).sum(axis=1))
        assert all(abs(d[i] - s) < 1e-18 for i, s in got[q]) and len({i for i, _ in got[q]} & set(np.argsort(d, kind="stable")[:11].tolist())) >= 7
    assert got[200] == [(i, 0.0) for i in range(201, 211)]  # 25 equal rows are one query


def test_neighbours_of_queries_that_repeat_over_several_blocks(spark, monkeypatch):
    """Against brute force, over more than three blocks: recall, repeated queries, one id with two vectors."""
    monkeypatch.setattr(ann, "BLOCK", 500)
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 16)) * 3
    x = (centres[rng.integers(40, size=2000)] + rng.standard_normal((2000, 16)) * 0.4).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[100]] * 2 + [(200, x[777].tolist())] + [(300, (x[300] * np.float32(-1) * np.float32(-1)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank", "score", "vec_id").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids, every = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)

    def nearest(q, v):
        d = np.sqrt(((every - v.astype(float)) ** 2).sum(axis=1))
        return [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]

    hits = total = 0
    for q in range(0, 2000, 100):
        expected = [p for v in ([x[200], x[777]] if q == 200 else [x[q]]) for p in nearest(q, v)]
        assert [r for r, _, _ in got[q]] == sorted([*range(1, 11)] * (2 if q == 200 else 1))
        true = {i: s for i, s in expected}
        assert all(abs(true[i] - s) < 1e-9 for _, i, s in got[q] if i in true)
        hits, total = hits + len({i for _, i, _ in got[q]} & set(true)), total + len(true)
    assert hits >= 0.9 * total, (hits, total)
