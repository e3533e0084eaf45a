"""Secret scans in DataFrame functions alone.

Four kinds of spans, in code points of the whole text, end exclusive: ``assign``
(a key word, a sign, a value), ``access`` (AKIA...), ``hex`` (long runs of 0-9a-f), and ``entropy``:
in runs of one character class (``CLASSES``) a window slides by one character, its
counts change by the character that enters and the one that leaves, and with them its Shannon
entropy; runs in which some window reaches the class's entropy and that no
pattern of ``ALLOWED`` matches whole are spans. Windows with a part of what ``FILLERS`` match don't count. Runs
of letters alone (and signs) that are words are left out; those in one case can't be told from words.
Allow-listing never removes a span of the first three kinds.

Null and empty texts have no spans. Rows that repeat give rows that repeat. An
empty table gives no rows. Matches are leftmost and don't overlap within a kind. Very long texts
take time in proportion to their length, in one task. Other columns of the table, whatever their names, stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
# A run that is long enough begins where the leftmost run of any length would: these find what a length filter keeps.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
#: Character class: alphabet and least entropy in bits of some window of WINDOW characters.
CLASSES = {
    "hex": ("0123456789abcdef", 3.0),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.6),
    "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.6),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Words in one case or in camel case, joined by signs, and a short number.
WORDS = r"^[+/_=-]*+(?:(?:[a-z]++|[A-Z]++|(?:[a-z]++)?(?:(?:[A-Z]{3,}+|[A-Z])[a-z]{2,}+)++(?:[A-Z]++)?)(?:[+/_=-]++|(?=[0-9]{0,4}$)))*+[0-9]{0,4}$"
#: Whole runs that are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]*$",
    WORDS,
)
_FILLER = "(?:example|sample|placeholder|changeme|dummy|your[_-]?(?:api[_-]?)?(?:key|token|secret))"
#: Parts of a run that are no secrets: a letters-and-digits piece with such a word, rows and repeats.
FILLERS = (
    rf"(?i)(?<![A-Za-z0-9])[A-Za-z0-9]*?{_FILLER}[A-Za-z0-9]*",
    r"(?i)0123456789|abcdefghij|(.)\1{7,}",
)
# Marks that can't be part of a match; texts that have the first get the second for it, at the same places.
_MARK, _OTHER = "\ue000", "\ue001"
_SPANS = "array<struct<start:bigint,stop:bigint,text:string>>"
#: Pieces of a text that are numbered together (even): an array that grows is copied at each step.
_GROUP = 64


def _matches(text: Column, pattern: str) -> Column:
    """Start, stop and text of all leftmost matches that don't overlap, in time linear in the text.

    The text is cut at its matches; every second piece is one. Pieces are numbered in groups of ``_GROUP``
    from the group's own start, and the groups' starts are added up once.
    """
    cut = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPANS).alias("found"))

    def piece(acc, part):
        stop = acc["at"] + F.length(part)
        own = F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"), part.alias("text")))
        return F.struct(stop.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    def grouped(parts):
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _GROUP).cast("int")), lambda g: F.slice(parts, g * _GROUP + 1, F.lit(_GROUP)))
        return F.transform(groups, lambda g: F.aggregate(g, empty, piece))

    def moved(groups):
        starts = F.aggregate(groups, F.array(F.lit(0).cast("long")), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"])))
        return _let(starts, lambda at: F.flatten(F.transform(groups, lambda g, i: F.transform(g["found"], lambda m: F.struct((m["start"] + F.get(at, i)).alias("start"), (m["stop"] + F.get(at, i)).alias("stop"), m["text"].alias("text"))))))

    return _let(cut, lambda parts: _let(grouped(parts), moved))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _guarded(text: Column, pattern: str, hint: Column, keep=None) -> Column:
    found = _matches(text, pattern)
    return F.when(hint, F.filter(found, keep) if keep else found).otherwise(F.array().cast(_SPANS))


def window_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any window of ``window`` characters (63 at most), by incremental counts; -1 without one.

    The state holds the count of each character of the class in the window, packed ten to an integer, and the sum of c * log2(c);
    a step changes the counts of the character that enters and the one that leaves, and two terms of the sum.
    """
    chars = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    start = F.struct(
        F.lit(1).alias("i"), F.array_repeat(F.lit(0).cast("long"), len(alphabet) // 10 + 1).alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(1e9).cast("double").alias("low")
    )
    place = lambda slot: F.struct(F.floor(slot / 10).cast("int").alias("word"), (slot % 10 * 6).alias("bit"))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at["bit"])
    count = lambda counts, at: F.call_function("shiftright", F.get(counts, at["word"]), at["bit"]).bitwiseAND(F.lit(63).cast("long")).cast("int")

    def step(acc, cs):
        new, old, full = cs["new"], cs["old"], acc["i"] > window
        n = count(acc["counts"], new)
        grown = acc["sum"] + F.get(terms, n + 1) - F.get(terms, n)
        m = count(acc["counts"], old) + F.when((new["word"] == old["word"]) & (new["bit"] == old["bit"]), 1).otherwise(0)
        gone = F.when(full, grown - F.get(terms, m) + F.get(terms, m - 1)).otherwise(grown)
        by = lambda x, k: x + F.when(k == new["word"], one(new)).otherwise(F.lit(0).cast("long")) - F.when(full & (k == old["word"]), one(old)).otherwise(F.lit(0).cast("long"))
        low = F.when(acc["i"] >= window, F.least(acc["low"], gone)).otherwise(acc["low"])
        return F.struct((acc["i"] + 1).alias("i"), F.transform(acc["counts"], by).alias("counts"), gone.alias("sum"), low.alias("low"))

    def best(slots):
        moves = F.transform(slots, lambda c, i: F.struct(place(c).alias("new"), place(F.coalesce(F.get(slots, i - window), F.lit(0))).alias("old")))
        return F.aggregate(moves, start, step, lambda acc: F.lit(math.log2(window)) - acc["low"] / window)

    return F.when(F.length(text) >= window, _let(chars, best)).otherwise(F.lit(-1.0))


def _dense(text: Column) -> Column:
    """Whether some window of a run reaches the entropy of the run's class."""
    (a, low), (b, high), (c, least) = CLASSES["hex"], CLASSES["base64"], CLASSES["letters"]
    folded = text.rlike("^[0-9a-fA-F]+$") & (window_entropy(F.lower(text), a) >= low)
    return folded | F.when(text.rlike("[0-9]"), window_entropy(text, b) >= high).otherwise(window_entropy(text, c) >= least)


def _suspicious(span: Column) -> Column:
    text = span["text"]
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | text.rlike(p)
    left, filled = text, F.lit(False)
    for p in FILLERS:
        left, filled = F.regexp_replace(left, p, " "), filled | text.rlike(p)
    pieces = F.filter(F.split(F.when(filled, left).otherwise(text), " "), lambda x: ~x.rlike(WORDS))
    return ~allowed & F.exists(pieces, _dense)


def spans_of(text: Column) -> dict[str, Column]:
    """For each kind, an array of (start, stop, text)."""
    lower = F.lower(text)
    words = lower.contains("password") | lower.contains("passwd") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    return {
        "assign": _guarded(text, ASSIGN, words, lambda m: m["text"].rlike(ASSIGN_VALUE)),
        "access": _guarded(text, ACCESS, text.contains("AKIA")),
        "hex": _guarded(text, HEX, text.rlike("[0-9a-f]{24}")),
        "entropy": _guarded(text, CANDIDATE, text.rlike("[A-Za-z0-9+/_=-]{20}"), _suspicious),
    }


def with_spans(docs: DataFrame, name: str = "secret_spans") -> DataFrame:
    """``docs`` with an array ``name`` of (start, order, stop, kind), by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(order: int, kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["stop"].alias("stop"), F.lit(kind).alias("kind"))

    found = [F.transform(spans, named(i, kind)) for i, (kind, spans) in enumerate(spans_of(text).items())]
    return docs.withColumn(name, F.sort_array(F.concat(*found)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = "[SECRET]", name: str = "secret_spans") -> DataFrame:
    """``docs`` with every span of its array ``name`` in ``text`` replaced by ``mask``; spans that overlap are one."""
    text, spans = F.col("text"), F.col(name)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        before = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], before).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(text))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets masked; ``n_chars``, where there is one, is the new length."""
    name = scratch.free_name("__secret_spans", docs.columns)
    out = redacted(with_spans(docs, name), name=name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and the digest of the base spans, and all spans as a string."""
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secret_spans")).alias("spans"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_digests(with_spans(docs))
