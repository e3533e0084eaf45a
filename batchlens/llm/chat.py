"""Chat formatting by a grammar round trip.

Template: ``<s>[role] L text</s>`` a turn, with F in the place of L where the text is escaped in full. Control strings inside a text are escaped by a backslash
before their first character, and backslashes that stand before a control string (or another such
backslash) are doubled, so unescaping is exact. Each rendered conversation is parsed again by a deterministic
parser and compared with its source; turns that differ are escaped in full (each
backslash and bracket) until what is parsed is identical.

Defined cases: a null text is empty; turns are ordered by turn, role, text with
nulls first; a null role is the empty role, whose marker is ``[]``; repeated
rows are turns of their own; a null conv_id is a conversation like any other. The loss mask covers the texts of assistant turns,
without their markers. Very long texts make segments of their own, each held whole. Columns other than conv_id, turn, role and text are not looked at,
so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import scratch

OPEN, CLOSE = "<s>", "</s>"
_CONTROL = re.compile(r"(\\*)(</?s>|\[/?[A-Za-z_]*\])")
_ROLE = re.compile(r"<s>\[((?:[^\]\\]|\\.)*)\] ", re.S)
#: A conversation's text is cut into segments of so many turns, or code points, at most.
TURNS, CHARS = 1024, 1 << 20
_UNESCAPE = re.compile(r"\\([\\<\[\]])", re.S)


def _light(text: str) -> str:
    """Backslashes double only before control strings; everything else stays as it is."""
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def _full(text: str) -> str:
    return re.sub(r"([\\<\[\]])", r"\\\1", text)


def render(turns: list[tuple[str, str]], full: set[int] = frozenset()) -> tuple[str, list[int]]:
    """The text of a conversation, and start and end (code points) of each assistant text under the loss mask.

    A turn is ``<s>[role] F|L text</s>``: L marks light escapes, F full ones.
    """
    out, at, mask = [], 0, []
    for i, (role, text) in enumerate(turns):
        kind = "F" if i in full else "L"
        head = f"{OPEN}[{_full(role)}] {kind} "
        body = _full(text) if i in full else _light(text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), mask


_END = re.compile(r"(?<!\\)(?:\\\\)*</s>")


def _plain(kind: str, body: str) -> str:
    if kind == "F":
        return _UNESCAPE.sub(r"\1", body)
    return re.sub(r"(\\+)(</?s>|\[/?[A-Za-z_]*\])", lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], body)


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """Role, text, and where the escaped text starts and ends, of each turn; None if ``text`` isn't in the grammar."""
    out, at = [], 0
    while at < len(text):
        head = _ROLE.match(text, at)
        if not head or text[head.end() : head.end() + 2] not in ("F ", "L "):
            return None
        begin = head.end() + 2
        end = _END.search(text, begin)
        if not end:
            return None
        stop = end.end() - len(CLOSE)
        out.append((_UNESCAPE.sub(r"\1", head[1]), _plain(text[head.end()], text[begin:stop]), begin, stop))
        at = end.end()
    return out


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """Render, parse and compare; conflicting turns are escaped in full until the round trip is identical."""
    full: set[int] = set()
    while True:
        text, mask = render(turns, full)
        got = parse(text)
        if got is not None and [(r, t) for r, t, _, _ in got] == turns:
            return text, mask
        wrong = [i for i, t in enumerate(turns) if i not in full and (lambda g: g is None or [x[:2] for x in g] != [t])(parse(render([t])[0]))]
        wrong = wrong or [i for i in range(len(turns)) if i not in full]
        if not wrong:
            raise ValueError("a conversation can't be formatted")
        full.update(wrong)


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of a conversation one after the other in one partition, in order; tasks stream them."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(rows: DataFrame, most: int = TURNS) -> DataFrame:
    """conv_id, segment, text, mask (start and end in code points of what counts for the loss).

    A conversation's text is that of its segments one after the other; it is one segment, unless it
    has more than ``most`` turns or ``CHARS`` code points. Its turns are never held together beyond a segment.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    turns = _by_conversation(rows.select(F.col("conv_id").cast("long"), "turn", role, text), "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        conv, segment, held, size, done = None, -1, [], 0, []

        def out():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["conv_id", "segment", "text", "mask"])

        for batch in batches:
            for c, r, t in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))):
                new = c != conv or segment < 0
                if held and (new or len(held) >= most or size + len(t) > CHARS):
                    done.append((conv, segment, *formatted(held)))
                    held, size, segment = [], 0, segment + 1
                if new:
                    conv, segment = c, 0
                held.append((r, t))
                size += len(t)
            yield out()
            done = []
        if held:
            done = [(conv, segment, *formatted(held))]
            yield out()

    return turns.mapInArrow(run, "conv_id long, segment long, text string, mask array<long>")


class _Digest:
    """What is read back of one conversation, segment by segment."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, mask: list[int]) -> None:
        turns = parse(text)
        kinds = {begin: text[begin - 2] for _, _, begin, _ in turns}
        loss = "".join(_plain(kinds[a], text[a:b]) for a, b in zip(mask[::2], mask[1::2]))
        self.turns, self.chars, self.loss_chars = self.turns + len(turns), self.chars + len(text), self.loss_chars + len(loss)
        self.said.update("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode("utf-8", "surrogatepass"))
        self.loss.update(loss.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(output: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        now, rows = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "mask"))):
                if now is None or conv != now.conv:
                    rows += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(text, mask)
            yield out()
            rows = []
        if now:
            rows = [now.row()]
            yield out()

    ordered = _by_conversation(output, "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema))
    return conversation_digests(scratch.saved(format_conversations(rows), "chat"))
