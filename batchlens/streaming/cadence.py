"""The cadence of verifications over a stream of samples: how many analyses each batch has run since the last one.

State is one small record a batch, in the state store. With ``idle``, a batch with no new samples for that long is dropped
from it; such a query looks for idle batches again and again, so it is for streams that don't end (a trigger that
stops when all is read never does).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from batchlens.model import ANALYSIS_TYPES

ROWS = "batch_id string, segment long, analyses long, ok boolean"
STATE = "segment long, analyses long"


def streamed_cadence(samples: DataFrame, every_n: int = 10, idle: str | None = None) -> DataFrame:
    """A row for each verification that arrives: its segment, the analyses before it, and whether they are few enough.

    ``samples``: a stream of batch_id, row_pos, type; within a batch, rows arrive in order across micro-batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[Any]:
        if state.hasTimedOut:
            state.remove()
            return
        segment, analyses = state.get if state.exists else (1, 0)
        rows = []
        for kind in pd.concat(list(frames)).sort_values("row_pos")["type"]:
            if kind == "CCV":
                rows.append((key[0], segment, analyses, analyses <= every_n))
                segment, analyses = segment + 1, 0
            else:
                analyses += kind in ANALYSIS_TYPES
        state.update((int(segment), int(analyses)))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=["batch_id", "segment", "analyses", "ok"])

    return samples.groupBy("batch_id").applyInPandasWithState(step, ROWS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
