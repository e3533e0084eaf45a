"""Names against many patterns: equal to trying each on each."""

import random
import re
import time

from pyspark.sql import functions as F

from batchlens.operators.names import matched_names, required_text


def test_required_texts():
    known = {
        "^CRM-EXAMPLE-1$": "crm-example-1", "(?i)nist\\s*16431": "16431", "^S1[0-9]$": None, "a(bc)d": "abcd", "(abc|abd)xyz": "xyz", "(?:foo)?barbaz": "barbaz", "(water){2,3}x": "water",
        "ab.cd": None, "a\\.b-c": "a.b-c", "[": None, "": None, "(?=look)here": "here", "(long)(er)[a-z]*tail": "longer", "x|yyyy": None, "ab*cde": "cde", "wasser\\b": "wasser", "é-abc": "-abc",
    }
    assert {p: required_text(p) for p in known} == known


def test_ten_thousand_patterns(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeS10-") for _ in range(n))
    names = sorted({word(rng.randrange(1, 14)) for _ in range(1500)} | {"", "ab", "NIST 1643f", "nist1643F"})
    shapes = ["^{0}$", "{0}", "(?i){0}", "{0}[0-9]", "{0}|{1}", "({0})?{1}", "({0}){{1,2}}", "^{1}.*{0}", "{0}\\b", "(?:{0}|{1})S"]
    patterns = []
    for i in range(10_000):
        a = rng.choice(names)[: rng.randrange(2, 9)] if i % 3 else word(rng.randrange(2, 7))
        patterns.append((i, rng.choice(shapes).format(re.escape(a) or "q", re.escape(word(3)))))
    patterns += [(10_000, "(?i)nist\\s*1643"), (10_001, None), (10_002, "[0-9"[:4] + "]")]
    table = spark.createDataFrame(patterns, "id int, pattern string").repartition(4)
    frame = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    began = time.time()
    got = sorted((r["name"], r["id"]) for r in matched_names(frame, table).collect())
    seconds = time.time() - began
    every = frame.join(table, F.expr("name rlike pattern"))
    assert got == sorted((r["name"], r["id"]) for r in every.select("name", "id").collect()) and len(got) > 10_000
    assert seconds < 60


def test_no_patterns_or_names(spark):
    none = spark.createDataFrame([], "id int, pattern string")
    some = spark.createDataFrame([(1, "abc")], "id int, pattern string")
    names = spark.createDataFrame([("xabcx",), ("ABC",)], "name string")
    assert matched_names(names, none).count() == 0 and matched_names(names.limit(0), some).count() == 0
    assert [tuple(r) for r in matched_names(names, some).select("name", "id").collect()] == [("xabcx", 1)]
