"""ST2: flight metrics carried across batches, with state that the watermark bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

METRICS = "flight long, shot long, t double, distance_to_prev double, time_diff_seconds double, late boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastShot(StatefulProcessor):
    """Keeps each flight's last shot, until event time has passed it by ``idle_ms``."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "x double, y double, t double, shot long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["t", "shot"])
        last = self.last.get()
        late = (batch[["t", "shot"]] == batch[["t", "shot"]].shift()).all(axis=1)
        if last is not None:
            late |= (batch["t"] < last[2]) | ((batch["t"] == last[2]) & (batch["shot"] <= last[3]))
        new = batch[~late]
        x0, y0, t0 = (new[c].shift(fill_value=np.nan if last is None else last[i]) for i, c in enumerate("xyt"))
        out = batch.assign(distance_to_prev=np.hypot(new["x"] - x0, new["y"] - y0), time_diff_seconds=new["t"] - t0, late=late, flight=key[0])
        if len(new):
            end = new.iloc[-1]
            due = int(end["t"] * 1000) + self.idle_ms
            if last is not None:
                self.handle.deleteTimer(last[4])
            self.handle.registerTimer(due)
            self.last.update((float(end["x"]), float(end["y"]), float(end["t"]), int(end["shot"]), due))
        yield out[[c.split()[0] for c in METRICS.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def flight_metrics_in_time(stream: DataFrame, *, time: str = "ts", lateness: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """ST2: step length and time against the flight's previous shot, in event time.

    State is one shot per flight, dropped by a timer when the watermark is
    ``idle_ms`` past it; a flight that goes on later begins anew. A shot at or
    before the last one is given as ``late`` and leaves the state alone; rows
    behind the watermark are given nothing, as in all of event time. ``t`` is
    ``time`` in seconds.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers and several states need it
    shots = stream.withWatermark(time, lateness)
    return shots.groupBy("flight").transformWithStateInPandas(statefulProcessor=LastShot(idle_ms), outputStructType=METRICS, outputMode="Append", timeMode="EventTime")
