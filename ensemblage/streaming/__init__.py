"""Event streams: windowed counts with late data, and running averages by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import is_directory


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder, or one such file, as a stream; event times become
    timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if not is_directory(spark, path):
        path, name = path.rstrip("/").rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def running_ema(events: DataFrame, key: str = "user_id", value: str = "value", alpha: float = 0.1, silence: str | None = None) -> DataFrame:
    """Exponential average of each key, carried as state from batch to batch; within
    a batch, values are folded in order of (ts, event_id), by weights and not one by one.
    State ends when nothing came for ``silence`` (processing time), if that is given."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ema, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches))
        v = rows[value].to_numpy(float)[np.lexsort((rows["event_id"], rows["ts"]))]
        weights = alpha * (1 - alpha) ** np.arange(len(v) - 1, -1, -1.0)
        ema, n = float((1 - alpha) ** len(v) * ema + weights @ v), n + len(v)
        state.update((ema, n))
        if silence:
            state.setTimeoutDuration(silence)
        yield pd.DataFrame({key: [k[0]], "ema": [ema], "n": [n]})

    rows = events.select(key, "ts", "event_id", value)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} long, ema double, n long", "ema double, n long", "update", timeout)
