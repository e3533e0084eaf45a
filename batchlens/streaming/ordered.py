"""The cadence of verifications, and types first seen, over a stream whose rows come in any order.

Rows of a batch wait in a list of the state store until the watermark has passed their time; a timer then takes them out in the order
of the run. What comes later than the watermark allows is dropped, as in any such stream. A batch with nothing new for ``idle`` is dropped from the
state by a timer of its own. The state store must be RocksDB
(``spark.sql.streaming.stateStore.providerClass``). State a batch: two numbers, the rows that still wait, and the distinct types.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from batchlens.model import ANALYSIS_TYPES

ROWS = "batch_id string, kind string, segment long, analyses long, type string, row_pos long, ok boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["batch_id", "kind", "segment", "analyses", "type", "row_pos", "ok"]


class Cadence(StatefulProcessor):
    """Holds rows until they are in order, then counts analyses between verifications and notes types first seen."""

    def __init__(self, every_n: int, idle_ms: int | None):
        self.every_n, self.idle_ms = every_n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row_pos long, type string, at long")
        self.counts = handle.getValueState("counts", "segment long, analyses long, last long")
        self.seen = handle.getListState("seen", "type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        at = new["at"].astype("int64") // {"s": 1, "ms": 1, "us": 1000, "ns": 10**6}[new["at"].dt.unit]
        if new["at"].dt.unit == "s":
            at *= 1000
        self.waiting.appendList([(int(r), t, int(a)) for r, t, a in zip(new["row_pos"], new["type"], at)])
        self.handle.registerTimer(int(at.min()))
        segment, analyses, last = self.counts.get() if self.counts.exists() else (1, 0, 0)
        last = max(int(last), int(at.max()))
        self.counts.update((int(segment), int(analyses), last))
        if self.idle_ms is not None:
            self.handle.registerTimer(last + self.idle_ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.counts.exists():
            return iter([])  # a timer of a batch that is gone
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in held if r[2] <= now], [r for r in held if r[2] > now]
        segment, analyses, last = self.counts.get()
        seen = {r[0] for r in self.seen.get()} if self.seen.exists() else set()
        rows = []
        for row_pos, kind, _ in ready:
            if kind not in seen:
                seen.add(kind)
                self.seen.appendValue((kind,))
                rows.append((key[0], "first seen", None, None, kind, row_pos, None))
            if kind == "CCV":
                rows.append((key[0], "segment", segment, analyses, None, row_pos, analyses <= self.every_n))
                segment, analyses = segment + 1, 0
            else:
                analyses += kind in ANALYSIS_TYPES
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[2] for r in rest))
        elif self.waiting.exists():
            self.waiting.clear()
        if self.idle_ms is not None and not rest and now >= last + self.idle_ms:
            self.counts.clear()
            self.seen.clear()
        else:
            self.counts.update((int(segment), int(analyses), int(last)))
        out = pd.DataFrame(rows, columns=_COLUMNS).astype({"segment": "Int64", "analyses": "Int64", "row_pos": "Int64", "ok": "boolean"})
        return iter([out] if rows else [])

    def close(self) -> None:
        pass


def ordered_cadence(samples: DataFrame, late: str = "10 minutes", every_n: int = 10, idle: str | None = None) -> DataFrame:
    """Rows of kind ``segment`` (a verification: its segment, the analyses before it, whether they are few enough) and ``first seen`` (a type's first row).

    ``samples``: a stream of batch_id, row_pos, type, at (the time of the sample), in any order within ``late``; at
    grows with row_pos within a batch.
    """
    rows = samples.selectExpr("batch_id", "cast(row_pos as long) as row_pos", "type", "at").withWatermark("at", late)
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("batch_id").transformWithStateInPandas(Cadence(every_n, idle_ms), ROWS, "Append", "EventTime")
