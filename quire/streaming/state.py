"""Runs as a stream with state of its own: each run is told once, when it ends, or when it has gone on too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_id string, state string, began timestamp, ended timestamp, micros long, events long"
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunTracker(StatefulProcessor):
    """State of a run: its first start, its last end, and how many events it had.

    A run whose start and end are both known is told as ``ended`` once the watermark has passed its end by ``settle``
    seconds, so that ends and starts that come late, in any order, are taken in; one whose end is still missing ``longest``
    seconds after its first event is told as ``open``. State goes when a run is told. An event that comes after
    that begins the run anew, and will be told as such.
    """

    def __init__(self, settle: int, longest: int):
        self.settle, self.longest = settle, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "began long, ended long, seen long, events long")

    def _known(self) -> list:
        return list(self.run.get()) if self.run.exists() else [None, None, None, 0]

    def _due(self, began, ended, seen) -> int:
        """When the run is to be told, in milliseconds of event time."""
        micros = max(began, ended) + self.settle * 1_000_000 if began is not None and ended is not None else seen + self.longest * 1_000_000
        return -(-micros // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        began, ended, seen, events = self._known()
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            starts, ends = micros[part["event"] == "start"], micros[part["event"].isin(["end", "error"])]
            began = min([*starts, *([] if began is None else [began])], default=None)
            ended = max([*ends, *([] if ended is None else [ended])], default=None)
            seen = min([*micros, *([] if seen is None else [seen])], default=None)
            events += len(part)
        as_int = lambda x: None if x is None else int(x)
        began, ended, seen = as_int(began), as_int(ended), as_int(seen)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        # a run that is told in this batch already would fire at once; its timer still waits for the watermark
        self.handle.registerTimer(max(self._due(began, ended, seen), timerValues.getCurrentWatermarkInMs() + 1))
        self.run.update((began, ended, seen, int(events)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, ended, _, events = self._known()
        self.run.clear()
        both = began is not None and ended is not None
        time = lambda x: pd.Timestamp(x, unit="us") if x is not None else pd.NaT
        state = "ended" if both else "open" if ended is None else "unstarted"
        yield pd.DataFrame({
            "run_id": [key[0]], "state": [state], "began": pd.Series([time(began)], dtype="datetime64[us]"), "ended": pd.Series([time(ended)], dtype="datetime64[us]"),
            "micros": pd.array([ended - began if both else None], "Int64"), "events": [events],
        })

    def close(self) -> None:
        pass


def tracked_runs(events: DataFrame, late: str = "10 minutes", settle: int = 60, longest: int = 3600) -> DataFrame:
    """(run_id, state, began, ended, micros, events) of a stream of (run_id, event, ts), one row a run in append mode.

    ``state`` is ended, open (no end within ``longest`` seconds of the first event) or unstarted. The state of a run is four numbers.
    Rows without run_id or ts are dropped, and rows later than the watermark as well. The session needs the state store ``STORE``.
    """
    spark = events.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}: timers need it")
    rows = events.where("run_id is not null and ts is not null").selectExpr("cast(run_id as string) as run_id", "event", "cast(ts as timestamp) as ts").withWatermark("ts", late)
    return rows.groupBy("run_id").transformWithStateInPandas(RunTracker(settle, longest), OUTPUT, "Append", "EventTime")
