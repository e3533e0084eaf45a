"""Words, shingles, token ids, rANS files and packing against plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from batchlens.llm import eliasfano, packing, rans, words
from batchlens.llm.bpe import Encoder, default_tokenizer, encoder

ROWS = [(3, "Hello, world! it's 42  times\n\n naïve ²x"), (1, None), (2, ""), (1, "same"), (1, "same"), (None, "no id"), (7, "ab <|endoftext|> cd"), (9, "x" * 5000 + " " + "longer words " * 2500), (8, "日本 text\x1c\x85 é")]
SCHEMA = "doc_id long, text string"


def library_ids(text):
    return encoder(default_tokenizer()).library.encode(text or "", add_special_tokens=False).ids


def test_words_and_shingles():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB c\n\té") for _ in range(rng.randrange(40))) for _ in range(400)] + [None, ""]
    split = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    for block in (19, 1 << 18):
        words._BLOCK = block
        h, at = words.word_hashes(pa.array(texts, pa.string()))
        assert np.diff(at).tolist() == [len(s) for s in split]
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip((w for s in split for w in s), h.tolist())) and len(set(seen.values())) == len(seen)
    for k in (1, 3, 5):
        s, cuts = words.shingle_hashes(h, at, k)
        expected = [[tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else [] for w in split]
        assert np.diff(cuts).tolist() == [len(e) for e in expected]
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip((w for e in expected for w in e), s.tolist()))


def test_encoder_equals_the_library():
    texts = [t for _, t in ROWS] + ["a" * n + "'s  \t\n" + " 12ab_!? " * n for n in range(6)]
    got = encoder(default_tokenizer()).ids(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library_ids(t) for t in texts]


def test_encoder_equals_the_library_on_random_texts():
    rng = random.Random(5)
    signs = list("aB1_'\" \t\n\r\x0b\x85\xa0é ß-.,stvremldɏª´²\x1c日😀") + ["'s", "'re", "'ll", "<|endoftext|>"]
    small = Encoder(default_tokenizer(), most=50)
    texts = ["it'", "s", "a'r", "e", " ", "\n", "b"] + [None if rng.random() < 0.03 else "".join(rng.choices(signs[: rng.choice([16, 30, 99])], k=rng.randrange(30))) for _ in range(6000)]
    column = pa.array(["cut off", *texts])[1:]
    got = [x for i in range(0, len(texts), 200) for x in small.ids(column[i : i + 200])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library_ids(t) for t in texts]
    assert small.ids(pa.array([], pa.string())) == [] and small.ids(pa.array([None, ""])) == [b"", b""]


def test_pieces_are_looked_up_once_a_slice():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    texts = ["one two, it's two" * 50, " one\n" * 300, "two one " * 300]
    encoder_ = Encoder(default_tokenizer())
    first = encoder_.ids(texts)
    encoder_.known = Counted(encoder_.known)
    assert encoder_.ids(texts) == first and 0 < encoder_.known.asked < 20
    assert [np.frombuffer(x, "<u2").tolist() for x in first] == [library_ids(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 16384, 16385, 40000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).choice([0, 3, 3, 3, 900, 50256], n).astype(np.uint16)
    coder = rans.Coder(rans.shared_table(np.bincount(ids, minlength=1 << 16)))
    assert (coder.decode(n, *coder.encode(ids)) == ids).all() if n else True


def test_rans_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rans.write_tokens(docs, str(tmp_path / "f"))
    got = rans.token_digests(rans.read_tokens(spark, str(tmp_path / "f"))).orderBy("start").collect()
    expected = sorted((([-1, 0][d is not None], d or 0), np.array(library_ids(t) + [0], "<u2").tobytes()) for d, t in ROWS)
    at = 0
    for r, ((known, d), raw) in zip(got, expected, strict=True):
        ids = np.frombuffer(raw, "<u2")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d if known == 0 else None, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
    rans.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert rans.read_tokens(spark, str(tmp_path / "empty")).count() == 0


def test_damaged_file_is_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    rans.write_tokens(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), str(tmp_path / "f"))
    parts = spark.read.parquet(str(tmp_path / "f/segments"))
    parts.withColumn("checksums", F.transform("checksums", lambda c: c + 1)).write.parquet(str(tmp_path / "g/segments"))
    spark.read.parquet(str(tmp_path / "f/table")).write.parquet(str(tmp_path / "g/table"))
    with pytest.raises(Exception, match="damaged block"):
        rans.read_tokens(spark, str(tmp_path / "g")).collect()


def test_best_fit():
    assert sorted(map(sorted, packing.best_fit(np.array([6, 4, 5, 5, 3, 7]), 10))) == [[0, 1], [2, 3], [4, 5]]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 3000)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sizes[b].sum() for b in bins) <= 100
    assert len(bins) <= -(-int(sizes.sum()) // 100) * 1.03


def test_packing(spark):
    docs = spark.createDataFrame(ROWS * 30, SCHEMA).repartition(5)
    rows = packing.packed_sequences(docs, with_ids=True).collect()
    by_seq, total = {}, 0
    for r in rows:
        assert len(r["ids"]) == 2 * r["length"] and zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == 30 * sum(len(library_ids(t)) + 1 for _, t in ROWS)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) <= max(-(-total // 2048), sum(r["length"] > 1024 for r in rows)) + 1
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 9)[:: 30]
    n = len(library_ids(ROWS[7][1])) + 1
    assert [x[2] for x in long] == [n % 2048] + [2048] * (n // 2048)
    assert packing.packed_sequences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (7, 20), (3000, 10**6), (3000, 2**63)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = eliasfano.EliasFano(eliasfano.unpack_arrays(np.frombuffer(b"".join(eliasfano.pack_arrays(eliasfano.build(v))), np.uint8)))
        keys = np.concatenate([v, rng.integers(0, top + 9, 500, dtype=np.uint64)])
        at, same = e.successor(keys)
        assert (same == np.isin(keys, v)).all() and (not n or (v[at[same]] == keys[same]).all())
        if n:
            assert (e.access(np.arange(n)) == v).all()
