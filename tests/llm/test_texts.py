"""Secrets, licences, chat and the pipeline against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from batchlens.llm import chat, licenses, scratch, secrets

DOCS = "doc_id long, text string"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text, re.A) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark):
    rng = random.Random(8)
    bits = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f" * 10, "é", "", "\n", "-", "x.y"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(600)] + [(900, None), (901, "")]
    got = {r["doc_id"]: r for r in secrets.secret_digests(secrets.with_spans(spark.createDataFrame(rows, DOCS))).collect()}
    for i, t in rows:
        spans = base_spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (t, r["spans"], listed)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == [s for s in listed.split(",") if s]


def test_window_entropy(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef0123456789"[: rng.randrange(1, 17)]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]

    def entropy(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.window_entropy(F.col("t"), secrets.CLASSES["hex"][0])).collect()]
    expected = [max((entropy(t[i : i + 20]) for i in range(len(t) - 19)), default=-1.0) for t in texts]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, expected))


def test_entropy_spans_and_allow_list(spark):
    secret = "aZ3kQ9vR7tLp2XwB8sNd4"
    rows = [(1, f"key {secret} end"), (2, "id 123e4567-e89b-42d3-a456-426614174000"), (3, f"{secret}example1"), (4, "averylongwordwithoutanydigits"), (5, f"a {secret}. token = {secret}")]
    docs = spark.createDataFrame(rows, DOCS + "").withColumn("n_chars", F.length("text")).withColumn("spans", F.lit("clash"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(secrets.with_spans(docs)).collect()}
    assert spans[1] == f"entropy:4:{4 + len(secret)}" and spans[2] == spans[3] == spans[4] == ""
    clean = {r["doc_id"]: r for r in secrets.cleaned(docs).collect()}
    assert clean[1]["text"] == "key [SECRET] end" and clean[1]["n_chars"] == 16 and clean[5]["text"] == "a [SECRET]. [SECRET]" and clean[4]["text"] == rows[3][1]
    assert list(clean[1].asDict()) == docs.columns and secrets.cleaned(docs.limit(0)).count() == 0


def test_entropy_of_upper_case_hex_letters_and_filled_runs(spark):
    rng = random.Random(3)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    secret = "aZ3kQ9vR7tLp2XwB8sNd4"
    found = [key("0123456789ABCDEF", n) for n in (24, 32, 40, 64) for _ in range(60)] + [key("0123456789abcdefABCDEF", 32) for _ in range(60)]
    mixed = [key(letters, n) for n in (20, 24, 32, 40) for _ in range(60)] + [key(letters, 24) + "7" for _ in range(60)]
    found += [f"example/{secret}", f"{secret}/docs/sample", f"{secret}AAAAAAAA{secret}", f"{secret}AAAAAAAAAAAAAAA", f"abcdefghij{secret}", "q" * 80 + secret]
    clean = ["someRatherLongCamelCaseName", "parseHTTPResponseBodyAndHeaders", "/usr/local/share/applications/defaults", "MAX_BUFFER_SIZE_OF_THE_TABLE", "Donaudampfschifffahrtsgesellschaft"]
    clean += ["12345678901234567890123", "0123456789abcdef0123456789abcdef"[:23].upper(), "=" * 40, "A" * 40 + "1", f"{secret}example1", "path/to/example/of/a/file1", "some-Long_path/withWords/2024", "a/Bcd" * 20000, "SomeWords" * 20000, "123E4567-E89B-42D3-A456-426614174000"]
    rows = list(enumerate([*found, *mixed, *clean]))
    out = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(secrets.with_spans(spark.createDataFrame(rows, DOCS))).collect()}
    hit = [f"entropy:0:{len(t)}" in out[i].split(",") for i, t in rows]
    assert [t for (i, t) in rows[: len(found)] if not hit[i]] == []
    assert sum(hit[len(found) : len(found) + len(mixed)]) >= 0.97 * len(mixed)
    assert [t for (i, t) in rows[-len(clean) :] if hit[i]] == []


def test_licences(spark):
    model = licenses.fitted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [(i, f"Some words first.\n{t}\nAnd more.") for i, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    rows += [(500 + i, t) for i, t in enumerate(licenses.OTHER_USES)] + [(900, None), (901, ""), (902, "\n\n"), (0, rows[0][1])]
    got = licenses.licensed_paragraphs(spark.createDataFrame(rows, DOCS), model).collect()
    right = sum(r["family"] == families[r["doc_id"]] for r in got if r["doc_id"] < 500)
    assert right >= 0.95 * (len(families) + 1) and not [r for r in got if r["doc_id"] >= 500]
    assert all(r["paragraph"] == 1 for r in got) and sum(r["confirmed"] for r in got) >= 0.95 * len(got)
    assert licenses.licensed_paragraphs(spark.createDataFrame([], DOCS), licenses.fitted(spark.createDataFrame([], DOCS))).count() == 0


def test_licences_that_begin_the_sampled_documents(spark):
    wanted = {t: f for f, ts in licenses.TEMPLATES.items() for t in ts if t.startswith(("Permission is", "Redistribution and", "Released under the GPL", "Released under the LGPL", "Released under the AGPL", "Proprietary and"))}
    assert len(wanted) == 6
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["rolo", "the", "mina", "of", "software", "source", "taku", "terms", "veli"]) for _ in range(12))
    rows = [(i, "\n".join([t, prose(), prose(), prose()])) for i, t in enumerate(list(wanted) * 50)]
    docs = spark.createDataFrame(rows, DOCS)
    model = licenses.fitted(docs)
    found = licenses.licensed_paragraphs(docs, model).collect()
    assert len(model.telling) < len(model.cues)
    model.telling = model.cues
    assert sorted(found) == sorted(licenses.licensed_paragraphs(docs, model).collect())
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in found}
    assert got == {(i, 0): wanted[t.split("\n")[0]] for i, t in rows}
    lines = [w for t in wanted for w in (t, " ".join(t.split()[:9]), "// " + t)] + licenses.OTHER_USES * 2
    kept = licenses.without_licences(lines)
    assert len(kept) == len(set(kept)) >= 8 and set(kept) <= set(licenses.OTHER_USES)


def test_chat_round_trip():
    rng = random.Random(0)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "a", " ", "[", "] ", "F ", "L ", "\n", "<", "s>", "[user]", "[]", "é"]
    for _ in range(4000):
        turns = [(rng.choice(["user", "assistant", "", "a]b", "\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(4))]
        text, mask = chat.formatted(turns)
        assert [t[:2] for t in chat.parse(text)] == turns and len(mask) == 2 * sum(r == "assistant" for r, _ in turns)


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] é"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 3, "system", ""), (1, None, "user", "first")]
    shown = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.conversation_digests(shown).collect()}
    cut = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=2)
    assert cut.where("conv_id = 1").count() == 2 and shown.where("conv_id = 1").count() == 1
    assert {r["conv_id"]: r for r in chat.conversation_digests(cut.repartition(3)).collect()} == got and len(got) == 3
    turns = [("user", "first"), ("user", "hi"), ("assistant", ""), ("assistant", "</s>[INST] é")]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("</s>[INST] é".encode()).hexdigest() and got[1]["loss_chars"] == 12 and got[1]["n_turns"] == 4
    assert got[2]["loss_chars"] == 0 and set(got) == {1, 2, None}
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from batchlens.llm import quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    ids = {r["doc_id"] for r in quality.op3_quality_classifier(spark, sf).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.saved(stage(spark, docs, sf), name)
        got = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality":
            assert got == ids
        if name == "secrets":
            assert got == before and not any(base_spans(t) for (t,) in out.select("text").collect())
        assert name == "packing" or out.columns == docs.columns
        docs, before = out, got
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_secrets_of_long_texts(spark):
    """Texts of 20,000 and 100,000 words, with many short runs and some long ones; candidates with a long front."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([3, 4, 5, 6, 26]) if rng.random() < 0.02 else rng.randrange(2, 7)))
    rows = [(n, " ".join(word() for _ in range(n)) + " token=abc secret: abcdefgh") for n in (20_000, 100_000)]
    key = "aZ3kQ9vR7tLp2XwB8sNd4yK"
    rows += [(1, "q" * 75 + key), (2, "xyz" + key), (3, ("b" * 75 + key + " ") * 150)]
    got = {r["doc_id"]: r for r in secrets.secret_digests(secrets.with_spans(spark.createDataFrame(rows, DOCS))).collect()}
    for i, t in rows:
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t))
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert got[1]["spans"] == "entropy:0:98" and got[2]["spans"] == "entropy:0:26" and got[3]["spans"].count("entropy") == 150


def test_licence_probabilities(spark):
    """The column functions against the model's own sums; templates that training left out fit the temperature."""
    model = licenses.Model(["plain words of a text", "mit der Bahn nach Hause", "more plain words here"])
    texts = ["released under the MIT License", "license of the GPL version 3 or later", "Licensed under CC BY 4.0.", "mit freundlichen Gruessen", "this software is not free"]
    got = {r["doc_id"]: r for r in licenses.licensed_paragraphs(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    for i, text in enumerate(texts):
        words = licenses.plain(text)
        z = model.intercept.astype(float).copy()
        for g in licenses._grams(words):
            if g in model.vocabulary:
                z += model.weights[model.vocabulary.index(g)]
        z = z / model.temperature
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(z)), key=lambda k: z[k])
        if model.families[best] == licenses.UNKNOWN or p[best] / sum(p) < licenses.LEAST:
            assert i not in got
        else:
            assert got[i]["family"] == model.families[best] and abs(got[i]["probability"] - p[best] / sum(p)) < 2e-4
    assert 0.3 <= model.temperature <= 6


def test_pipeline_of_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows and an empty table, through each stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs.first()
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), one, one, (None, "a b c d e f g", None, "x", None)]
    for rows in (odd, []):
        held = spark.createDataFrame(rows, docs.schema)
        for name, stage in corpus_pipeline.STAGES:
            held = scratch.saved(stage(spark, held, sf), name)
            assert name == "packing" or held.columns == docs.columns
        assert (held.count() > 0) is bool(rows)


def test_share_of_notices_found(spark):
    """Of the lines of a table that name a licence at least 98 in 100 are found, of plain prose none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licenses.fitted(docs)
    own = [
        (1, "All rights reserved.\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: BSD-3-Clause\nCopyright 2023 Acme Inc."),
        (2, "Released under the EPL 2.0.\nLicensed under the EUPL.\nDistributed under the Boost Software License, Version 1.0.\nReleased under the Unlicense"),
        (3, "\n".join(["The year 2020 was long.", "He was rights-minded and reserved.", *licenses.OTHER_USES])), (4, None), (5, ""), (6, "word " * 400_000 + "\nAll rights reserved."),
    ]
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.licensed_paragraphs(spark.createDataFrame(own, DOCS).withColumns({c: F.lit(1) for c in ("words", "pairs", "family")}), model).collect()}
    families = ["Proprietary", "MIT", "BSD", "Proprietary", "EPL", "EUPL", "BSL-1.0", "Public-Domain"]
    assert found == {**{(1 + i // 4, i % 4): f for i, f in enumerate(families)}, (6, 1): "Proprietary"}
    got = {(r["doc_id"], r["paragraph"]) for r in licenses.licensed_paragraphs(docs, model).collect()}
    named = {(r["doc_id"], i) for r in docs.collect() for i, line in enumerate((r["text"] or "").split("\n")) if licenses.LICENCE.search(line)}
    assert len(named) > 40 and len(got & named) >= 0.98 * len(named) and len(got - named) <= 0.02 * len(named)


def test_columns_with_clashing_names_in_the_stages(spark):
    """Every stage but the last keeps a table's columns and their values, whatever their names."""
    from batchlens.llm import decontam, jaccard_join, quality

    names = ["__score", "__SECRET_SPANS", "__plain", "__row", "__row_", "key", "score", "similarity", "component_id", "part"]
    rows = [(i, f"text number {i} of several words that differ {i * 7} token = abcdef{i}{i} end") for i in range(20)] + [(20, None), (21, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "nothing of the kind is in any of these texts at all")], "item_id long, text string")
    stages = [lambda d: quality.accepted(d, labels, 0.0), lambda d: jaccard_join.one_of_each(d), lambda d: decontam.uncontaminated(d, benchmark), secrets.cleaned]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        kept = out.collect()
        assert len(kept) >= 20 and all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in names)
