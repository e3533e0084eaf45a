"""Fill-in-the-middle texts, a whole Arrow batch of texts at a time.

A byte of UTF-8 belongs to a class (letter, other first byte of a code point, continuation byte).
Comparing each byte's class with that of the byte before gives the mask of bytes at which a unit
(``[A-Za-z]+|[^A-Za-z]``) begins; its running sum, less the sum at the document's first byte, numbers
the units of each document. Binary search in the running sum finds the cuts of all rows at once,
and one gather of bytes writes all outputs.

A document's draws are the first 8-digit groups of the hex sha256 of ``<seed>:<doc_id>``. Output: psm,
``<P>`` prefix ``<S>`` suffix ``<M>`` middle; spm, ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; plain, the text.
A text that holds a marker stays plain, so in any other output each marker stands once and the text
can be read back from it (``restored``).

Defined cases: a null text is empty; empty texts are plain; a null doc_id draws as the empty string. Rows that
repeat are rows of their own. Very long texts are cut like others: a slice of a batch holds about 4 MB of
texts, or one longer text whole. Columns other than doc_id and text are not looked at, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.words import sliced, texts_of

PLAIN, PSM, SPM = "plain", "psm", "spm"
_MARKS = np.frombuffer(b"<P><S><M>", np.uint8)
_LETTER, _OTHER, _INSIDE = 2, 1, 0
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _INSIDE
_CLASS[65:91] = _CLASS[97:123] = _LETTER


def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a marker begins; none reaches over the end of a text."""
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], _MARKS[1::3])) if len(data) > 2 else np.zeros(0, np.int64)
    return at[at + 3 <= offsets[np.searchsorted(offsets, at, "right")]] if len(at) else at


def _gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of which row i is the pieces ``source[starts[i, j] : starts[i, j] + sizes[i, j]]``, one after the other."""
    ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int64)
    starts, sizes = starts.ravel()[sizes.ravel() > 0], sizes.ravel()[sizes.ravel() > 0]
    step = np.ones(int(ends[-1]), np.int64)
    if len(sizes):
        first = np.cumsum(sizes) - sizes
        step[first] = starts - np.concatenate([[0], starts[:-1] + sizes[:-1] - 1])
    out = source[np.cumsum(step)] if len(step) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out)))


def _cut(column: pa.Array, draws: list[np.ndarray], fim: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a column of texts with four draws each."""
    data, offsets = texts_of(column)
    begin, end = offsets[:-1], offsets[1:]
    kind = _CLASS[data]
    unit = kind == _OTHER
    letter = kind == _LETTER
    unit |= letter
    unit[1:] &= ~(letter[1:] & letter[:-1])
    heads = begin[(begin < end)]
    unit[heads] = True  # a text begins a unit, whatever stands before it
    units = np.concatenate([[0], np.cumsum(unit)])
    chars = np.concatenate([[0], np.cumsum(kind != _INSIDE)])
    n = units[end] - units[begin]

    marks = _marks(data, offsets)
    holds = np.zeros(len(n), bool)
    holds[np.searchsorted(offsets, marks, "right") - 1] = True
    plain = (n == 0) | holds | (draws[2] % 100 >= fim)
    is_spm = ~plain & (draws[3] % 100 < spm)
    a, b = (d % (n + 1) for d in draws[:2])
    # the byte at which unit u of a row begins is the first whose running sum is past the row's sum by u + 1
    one, two = (np.minimum(np.searchsorted(units[1:], units[begin] + u + 1), end) for u in (np.minimum(a, b), np.maximum(a, b)))

    size = len(data)
    source = np.concatenate([data, _MARKS])
    whole, zero = np.stack([begin, begin, begin, begin, begin, begin], 1), np.zeros(len(n), np.int64)
    mark = zero + 3
    as_plain = np.stack([end - begin, zero, zero, zero, zero, zero], 1)
    prefix, suffix, middle = (begin, one - begin), (two, end - two), (one, two - one)
    psm = [(zero + size, mark), prefix, (zero + size + 3, mark), suffix, (zero + size + 6, mark), middle]
    spm_ = [psm[2], suffix, psm[0], prefix, psm[4], middle]
    at, sizes = (np.where(is_spm[:, None], np.stack([p[i] for p in spm_], 1), np.stack([p[i] for p in psm], 1)) for i in (0, 1))
    output = _gathered(source, np.where(plain[:, None], whole, at), np.where(plain[:, None], as_plain, sizes))
    form = pa.array(np.array([PSM, SPM, PLAIN])[np.where(plain, 2, is_spm.astype(int))], pa.string())
    return [pa.array(n), form, pa.array(chars[one] - chars[begin], mask=plain), pa.array(chars[two] - chars[one], mask=plain), output]


def _rebuilt(column: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs were made of."""
    data, offsets = texts_of(column)
    begin, end = offsets[:-1], offsets[1:]
    form = np.array(forms.to_pylist(), object)
    plain, spm = form == PLAIN, form == SPM
    marks = _marks(data, offsets)
    at = marks[np.isin(np.searchsorted(offsets, marks, "right") - 1, np.flatnonzero(~plain))].reshape(-1, 3)  # three a row
    second, third = begin.copy(), begin.copy()
    second[~plain], third[~plain] = at[:, 1], at[:, 2]
    one, two, three = (begin + 3, second - begin - 3), (second + 3, third - second - 3), (third + 3, end - third - 3)
    pieces = [tuple(np.where(spm, x, y) for x, y in zip(p, q)) for p, q in ((two, one), (three, three), (one, two))]
    zero = np.zeros(len(begin), np.int64)
    starts = np.stack([np.where(plain, begin, p[0]) for p in pieces], 1)
    sizes = np.stack([np.where(plain, x, p[1]) for p, x in zip(pieces, (end - begin, zero, zero))], 1)
    return _gathered(data, starts, sizes)


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output: every row of ``docs`` (doc_id, text) transformed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *_draws(F.col("doc_id"), seed))

    def run(batches):
        for batch in sliced(batches, "text"):
            cut = _cut(batch.column("text"), [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)], fim_percent, spm_percent)
            cut[-1] = cut[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cut], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, the text read back from output and form alone."""

    def run(batches):
        for batch in sliced(batches, "output"):
            text = _rebuilt(batch.column("output"), batch.column("form")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "restored"])

    kept = output.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return kept.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, cast(('0x' || h[1:8]) as bigint) as h1, cast(('0x' || h[9:16]) as bigint) as h2,
  cast(('0x' || h[17:24]) as bigint) as h3, cast(('0x' || h[25:32]) as bigint) as h4 from t),
v as (select *, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
w as (select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s from v)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from w
"""
