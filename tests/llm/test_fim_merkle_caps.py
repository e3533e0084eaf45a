"""Fill-in-the-middle, Merkle proofs and spherical caps against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from batchlens.llm import caps, fim, merkle

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text, fim_percent=90, spm_percent=20, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm_percent:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_texts(rng, n):
    bits = ["a", "Zz", "word", " ", "\n", "é", "日本", "😀", "<P", "<", ">", "S>", "<M>", "1", "\x00", "\t", ".", "P"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_fill_in_middle(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(random_texts(rng, 1500))] + [(7, None), (None, "no id here"), (-3, "negative id"), (8, ""), (8, "")]
    rows += [(90000 + i, "word é日 " * 120_000 + "x" * 1_000_000) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("output", F.lit("clash")).withColumn("h1", F.lit(1)).withColumn("form", F.lit(2)).repartition(3)
    for most, spm in ((90, 20), (100, 100), (100, 0)):
        got = fim.restored(fim.fill_in_middle(docs, most, spm)).collect()
        expected = [plain_fim(i, t, most, spm) for i, t in rows]
        assert sorted(map(repr, [tuple(r)[:6] for r in got])) == sorted(map(repr, expected))
        assert sorted(map(repr, [(r["doc_id"], r["restored"]) for r in got])) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm"}
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_fim_seed_changes_cuts(spark):
    docs = spark.createDataFrame([(i, "some words to cut, " * 9) for i in range(50)], DOCS)
    one, two = ({r["doc_id"]: r["output"] for r in fim.fill_in_middle(docs, seed=s).collect()} for s in (1, 2))
    assert one != two and one == {r["doc_id"]: r["output"] for r in fim.fill_in_middle(docs.repartition(7)).collect()}


TABLE = "doc_id long, source string, lang string, n_chars long, text string"


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((i % 3, [level[j] for j in range(first, min(first + 3, len(level))) if j != i]))
        i //= 3
    return out


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, path, in the order of the manifest."""
    digest = lambda r: sha("".join(field(v) for v in (r[0], r[1], r[2], r[3], r[4])))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for s in sources}
    trees = {s: plain_tree([digest(r) for r in ordered[s]]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(ordered[s]):
            out.append((r, trees[s][0][i], trees[s][-1][0], top[-1][0], plain_path(trees[s], i) + plain_path(top, k)))
    return out


def test_traversal_equals_whole_trees():
    for n in [*range(1, 40), 80, 81, 82, 243, 244, 500, 728, 729]:
        leaves = [sha(str(i)) for i in range(n)]
        levels = plain_tree(leaves)
        encoded = [x.encode() for x in leaves]
        got = list(merkle.traversal(encoded.__getitem__, n, len(levels) - 1))
        assert [[(p, [x.decode() for x in o]) for p, o in zip(*step)] for step in got] == [plain_path(levels, i) for i in range(n)]
        assert merkle.root_of(encoded.__getitem__, n, len(levels) - 1).decode() == levels[-1][0]
    short = merkle.root_of([b"ab"].__getitem__, 1, 3)  # a lone node of a taller tree is hashed at each level
    assert short.decode() == sha(sha(sha("ab")))


def test_traversal_keeps_few_nodes(monkeypatch):
    most = 0

    class Counted(merkle._Subtree):
        def add(self, leaf):
            nonlocal most
            super().add(leaf)
            most = max(most, len(self.kept))

    monkeypatch.setattr(merkle, "_Subtree", Counted)
    leaves = [sha(str(i)).encode() for i in range(729)]
    assert sum(1 for _ in merkle.traversal(leaves.__getitem__, 729, 6)) == 729
    assert most <= 9 + 3 + 1  # of a stage of two levels, not of the 1,093 nodes of the tree


def merkle_rows(rng):
    rows = [(rng.randrange(10**6) - 500, f"s{rng.choice('abé')}", rng.choice(["en", None]), rng.randrange(99), t) for t in random_texts(rng, 400)]
    rows += [(i, "hot", "en", 3, f"line\n{i}") for i in range(2300)] + [rows[0]] * 3 + [(None, None, None, None, None), (None, "hot", None, 0, ""), (5, None, "x", 1, "a\nb"), (5, None, "x", 1, "a\nc"), (6, "", "x", None, "1:a")]
    return rows + [(7, "long", "en", 1, "wörd\n" * 400_000)]


def test_merkle_manifest(spark):
    rng = random.Random(3)
    rows = merkle_rows(rng)
    docs = spark.createDataFrame(rows, TABLE).withColumns({c: F.lit("clash") for c in ("grp", "leaf", "root", "pos", "item", "digest")}).repartition(6)
    got = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], list(zip(r["places"], r["siblings"]))) for r in merkle.manifest(docs).collect()]
    expected = [(r[0], r[1], leaf, subroot, root, path) for r, leaf, subroot, root, path in plain_manifest(rows)]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_merkle_query_shows_what_changed(spark, tmp_path):
    rng = random.Random(4)
    rows = merkle_rows(rng)
    spark.createDataFrame(rows, TABLE).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    expected = []
    for r, leaf, subroot, root, path in plain_manifest(rows):
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        node = sha("".join(field(v) for v in (*r[:4], r[4].replace("\n", "") if r[4] is not None else None))) if changed else leaf
        for place, others in path:
            node = sha("".join([*others[:place], node, *others[place:]]))
        expected.append((r[0], leaf, subroot, root, sha("".join(x for _, o in path for x in o)), node, node == root))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert {r["verified"] for r in got} == {True, False}


def test_merkle_of_one_row(spark):
    (got,) = merkle.manifest(spark.createDataFrame([(1, "a", "en", 2, "hi")], TABLE)).collect()
    assert got["leaf"] == got["subroot"] == got["root"] == sha("1:11:a2:en1:22:hi") and got["places"] == [] == got["siblings"]


VECTORS = "vec_id long, label int, embedding array<float>"


def near(rng, x, cosine):
    """A vector with this cosine to ``x``."""
    w = rng.standard_normal(len(x))
    w -= (w @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def plain_links(rows, threshold=0.98):
    """n_links and component of each row, by all cosines of a label."""
    ok = [i for i, (v, label, x) in enumerate(rows) if v is not None and label is not None and x is not None and None not in x and np.isfinite(x).all() and any(x)]
    links, root = [0] * len(rows), list(range(len(rows)))
    for label in {rows[i][1] for i in ok}:
        own = [i for i in ok if rows[i][1] == label]
        x = np.array([rows[i][2] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        for i, line in zip(own, linked):
            links[i] = int(line.sum())
        open_ = set(range(len(own)))
        while open_:
            todo, seen = [open_.pop()], []
            while todo:
                seen.append(todo.pop())
                todo += (more := open_ & set(np.flatnonzero(linked[seen[-1]]).tolist()))
                open_ -= more
            low = min(rows[own[i]][0] for i in seen)
            for i in seen:
                root[own[i]] = low
    return [(v, n, root[i] if i in set(ok) else v) for i, ((v, _, _), n) in enumerate(zip(rows, links))]


def test_caps_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for width, vectors in ((64, 500), (64, 50_000), (16, 2000), (384, 5000), (6, 300), (1, 20)):
        x = rng.standard_normal((1500, width))
        y = np.array([near(rng, v, 0.98) for v in x]) if width > 1 else x * 3
        code = caps.ProductCode(width, vectors, 0.98)
        one, two = (code.decoded(v) for v in (x, y))
        met = len({r for r, d in set(zip(*map(np.ndarray.tolist, one))) & set(zip(*map(np.ndarray.tolist, two)))})
        assert met >= 0.995 * len(x), (width, vectors, met)
        lone = code.decoded(x[7:8])  # a vector's filters don't depend on what stands beside it
        row, at = code.decoded(x)
        assert at[row == 7].tolist() == list(lone)[1].tolist()


def test_decoding_gives_all_directions_past_the_cap():
    rng = np.random.default_rng(5)
    code = caps.ProductCode(32, 100, 0.98)
    x = rng.standard_normal((40, 32))
    y = code._rotated(x).reshape(40, code.blocks, -1)
    sums = np.zeros((40, 1))
    for b in range(code.blocks):
        sums = (sums[:, :, None] + (y[:, b] @ code.code[b].T)[:, None, :]).reshape(40, -1)
    limit = np.minimum(code.height, sums.max(axis=1) - code.slack)
    expected = [(i, d) for i in range(40) for d in np.flatnonzero(sums[i] >= limit[i]).tolist()]
    assert list(zip(*map(np.ndarray.tolist, code.decoded(x)))) == expected


def test_spherical_caps(spark, monkeypatch):
    monkeypatch.setattr(caps, "SPLIT", 40)  # so that groups are split over tasks
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(3)), rng.standard_normal(24).tolist()) for i in range(600)]
    for i in range(150):  # pairs about the threshold, in chains and across labels
        v, label, x = rows[int(rng.integers(len(rows)))]
        rows.append((1000 + i, label if i % 5 else 7, near(rng, np.array(x), rng.choice([0.97, 0.979, 0.981, 0.985, 0.995])).tolist()))
    centre = rng.standard_normal(24)
    rows += [(3000 + i, 1, near(rng, centre, rng.uniform(0.985, 0.999)).tolist()) for i in range(200)]
    rows += [(4000 + i, 2, [0.5] * 23 + [-0.0]) for i in range(60)] + [(4100 + i, 2, [1.0] * 23 + [0.0]) for i in range(30)] + [rows[0]] * 4
    odd = [(5000, 1, None), (5001, 1, [0.0] * 24), (5002, 1, [1.0] * 23 + [None]), (5003, 1, [float("nan")] * 24), (5004, None, [0.5] * 24), (None, 2, [0.5] * 24), (5005, 2, [1.0, 2.0]), (5006, 2, []), (5007, 1, [float("inf")] * 24)]
    short = [r for r in odd if r[0] != 5005]
    table = spark.createDataFrame(rows + odd, VECTORS).withColumns({c: F.lit("clash") for c in ("key", "x", "cap", "copies", "links")}).repartition(5)
    got = [tuple(r) for r in caps.near_duplicates(table).collect()]
    expected = plain_links(rows + short) + [(5005, 0, 5005)]
    assert sorted(map(repr, ((v, n, c, None if v is None else v == c) for v, n, c in expected))) == sorted(map(repr, got))
    assert caps.near_duplicates(table.limit(0)).count() == 0
    double = table.where("vec_id < 1300").withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(tuple(r)[:3] for r in caps.near_duplicates(double).collect()) == sorted(plain_links([r for r in rows if r[0] < 1300]))
