"""Streams of edits: debounce with one timer for each note, and passes over micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key bigint, first double, last double, n_edits bigint"


class Debounce(StatefulProcessor):
    """Holds a note's open session; emits it once ``gap_s`` have passed since its last edit, in event time."""

    def __init__(self, gap_s: float):
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "first double, last double, n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        times = sorted(t for pdf in rows for t in pdf["ts_s"])
        state = self.session.get() if self.session.exists() else None
        first, last, n = state if state else (None, None, 0)
        done = []
        for t in times:
            if last is not None and t - last >= self.gap_s:
                done.append((key[0], first, last, n))
                first, last, n = None, None, 0
            first = t if first is None else min(first, t)
            last = t if last is None else max(last, t)
            n += 1
        if last is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last + self.gap_s) * 1000))
            self.session.update((first, last, n))
        yield pd.DataFrame(done, columns=["key", "first", "last", "n_edits"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.session.exists():
            first, last, n = self.session.get()
            self.session.clear()
            yield pd.DataFrame([(key[0], first, last, n)], columns=["key", "first", "last", "n_edits"])

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, gap_s: float, late: str = "0 seconds") -> DataFrame:
    """Sessions of a stream of edits (key bigint, ts timestamp, ts_s double).  Needs the RocksDB state store."""
    keyed = edits.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(statefulProcessor=Debounce(gap_s), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):  # noqa: ANN201
    """Run ``step`` on every micro-batch: at intervals, or once over what is there."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
