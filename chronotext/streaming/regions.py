"""Hysteresis regions over a stream of scores: state is kept for each key between batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_regions(scores: DataFrame, key: str, ts: str = "ts", score: str = "score", onset: float = 0.5, offset: float | None = None, lateness: str = "10 seconds") -> DataFrame:
    """(key, start, end) of each closed region, emitted when its end arrives or when the watermark has passed an open one.

    ts is a timestamp; scores later than the watermark are dropped, those within a batch are put in order.
    """
    low = offset or onset
    kind = scores.schema[key].dataType.simpleString()

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, last = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            if begun is not None:
                out.append((k[0], begun, last))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("__ts", kind="stable")
            for t, y in zip(rows["__ts"], rows["__y"]):
                if begun is None and y > onset:
                    begun = t
                elif begun is not None and y < low:
                    out.append((k[0], begun, t))
                    begun = None
                last = t
            state.update((begun, last))
            state.setTimeoutTimestamp(max(int(last / 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "start", "end"])

    slim = scores.withWatermark(ts, lateness).select(key, ts, F.unix_micros(F.col(ts)).alias("__ts"), F.col(score).cast("double").alias("__y"))
    found = slim.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, start long, end long", "begun long, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"))
