"""The latest operation on a document wins: results of operations that a later one has superseded are dropped.

Events (doc_id, op, kind, at, value): an operation is announced by a row of kind `start`, gives rows of kind `result`, and
ends what came before it; a row of kind `cancel` ends its own. Events may come in any order within the watermark. State
is one number a document and goes when the watermark has passed the document's last event by the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([T.StructField("op", T.LongType()), T.StructField("cancelled", T.BooleanType()), T.StructField("until", T.LongType())])
EVENT = "doc_id long, op long, kind string, at timestamp, value string"


def newest(op: int, cancelled: bool, rows: pd.DataFrame) -> tuple[int, bool]:
    """The latest operation of a state and further rows, and whether it is cancelled; results announce their operation too."""
    last = int(max([op, *rows["op"]]))
    ended = bool(((rows["op"] == last) & (rows["kind"] == "cancel")).any())
    return last, ended or (cancelled and last == op)


class LatestWins(StatefulProcessor):
    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(rows)
        op, cancelled, until = self.latest.get() if self.latest.exists() else (-1, False, 0)
        op, cancelled = newest(op, cancelled, rows)
        due = max(int(rows["at"].max().timestamp() * 1000) + self.delay_ms, until)
        if due > until:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.latest.update((op, cancelled, due))
        own = rows[(rows["kind"] == "result") & (rows["op"] == op)]
        if len(own) and not cancelled:
            yield own[["doc_id", "op", "at", "value"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_results(events: DataFrame, delay: str = "10 minutes", delay_ms: int = 600_000) -> DataFrame:
    """Results (doc_id, op, at, value) of a stream of events (EVENT), without those that are superseded when they come.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.withWatermark("at", delay)
    return rows.groupBy("doc_id").transformWithStateInPandas(LatestWins(delay_ms), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("op", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("value", T.StringType())]), "Append", "EventTime")
