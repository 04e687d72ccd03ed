"""ST1, ST2: incremental shot ingest and flight metrics with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

METRICS = "flight long, shot long, t double, distance_to_prev double, time_diff_seconds double, late boolean"


def deduplicated(stream: DataFrame, *, path: str = "filepath", time: str = "ts", lateness: str = "1 day") -> DataFrame:
    """ST1: each path once within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([path])


def append_new(batch: DataFrame, batch_id: int, folder: str, path: str = "filepath") -> None:
    """ST1: a foreachBatch sink that is idempotent by batch and by path.

    A batch writes the folder of its own number, so a repeated one replaces it;
    paths that other batches have written are left out.
    """
    spark = batch.sparkSession
    out = f"{folder}/batch={batch_id}"
    try:
        known = spark.read.parquet(folder).where(F.col("batch") != batch_id).select(path)
        batch = batch.join(known, path, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    batch.write.mode("overwrite").parquet(out)


def _step(idle_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["t", "shot"])
    last = state.get if state.exists else None
    late = (rows[["t", "shot"]] == rows[["t", "shot"]].shift()).all(axis=1)
    if last is not None:
        late |= (rows["t"] < last[2]) | ((rows["t"] == last[2]) & (rows["shot"] <= last[3]))
    new = rows[~late]
    x0, y0, t0 = (new[c].shift(fill_value=np.nan if last is None else last[i]) for i, c in enumerate("xyt"))
    known = rows.assign(distance_to_prev=np.hypot(new["x"] - x0, new["y"] - y0), time_diff_seconds=new["t"] - t0, late=late, flight=key[0])
    if len(new):
        end = new.iloc[-1]
        state.update((float(end["x"]), float(end["y"]), float(end["t"]), int(end["shot"])))
    if idle_ms and state.exists:
        state.setTimeoutDuration(idle_ms)
    yield known[[c.split()[0] for c in METRICS.split(", ")]]


def flight_metrics(stream: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """ST2: step length and time against the flight's previous shot, carried across batches.

    State is one shot per flight. A shot at or before it comes too late: it is
    given as ``late`` and leaves the state alone. With ``idle_ms`` the state of a
    flight that had no shots for so long is dropped; such a stream has timers, so
    it needs a trigger that goes on, not one that ends with the data.
    """
    step = lambda key, batches, state: _step(idle_ms, key, batches, state)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("flight").applyInPandasWithState(step, METRICS, "x double, y double, t double, shot long", "append", timeout)
