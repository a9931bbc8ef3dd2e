"""Streaming: metric rows into points and rollups, and a reorder buffer for each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridtide.operators.grid import ceil_to
from gridtide.sources.metrics import definitions, points_of, validated


def stream_rollups(points: DataFrame, span: int, late: str = "10 minutes") -> DataFrame:
    """Rollups of a stream of points (sid, ts, val), each stamped with its end; points later than the watermark are left out."""
    timed = points.where("val IS NOT NULL").withColumn("at", F.timestamp_seconds(ceil_to(F.col("ts"), F.lit(span)))).withWatermark("at", late)
    sums = timed.groupBy("sid", "at").agg(F.sum("val").alias("sum"), F.count("val").alias("cnt"), F.min("val").alias("min"), F.max("val").alias("max"), F.max_by("val", "ts").alias("lst"))
    return sums.select("sid", F.lit(span).alias("span"), F.unix_timestamp("at").alias("ts"), "sum", "cnt", "min", "max", "lst")


def timely(metrics: DataFrame, future_tolerance: int | None = None, ingest_from: dict[int, int] | None = None, now: Column | None = None) -> DataFrame:
    """Validated rows, with a further reason for those whose time is more than future_tolerance seconds ahead of now, or before the time from which their organisation's points are taken."""
    reason, now = F.col("reason"), F.unix_timestamp() if now is None else now
    if future_tolerance is not None:
        reason = F.coalesce(reason, F.when(F.col("time") - future_tolerance > now, "too-far-ahead"))
    for org, first in (ingest_from or {}).items():
        reason = F.coalesce(reason, F.when((F.col("org") == org) & (F.col("time") < first), "before-ingest-from"))
    return metrics.withColumn("reason", reason)


_POINTS = "sid string, ts long, val double"


def _slots(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, int]:
    """Times rounded up to the interval, values, and the interval, in the order of arrival."""
    whole = pd.concat(list(batches))
    interval = int(whole["interval"].iloc[0])
    return -(-whole["ts"].to_numpy(np.int64) // interval) * interval, whole["val"].to_numpy(float), interval


def _emitted(sid: str, times: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"sid": sid, "ts": times, "val": values}, columns=["sid", "ts", "val"])


def reorder(points: DataFrame, window: int, allow_update: bool = False, idle: str = "1 hour") -> DataFrame:
    """Points (sid, interval, ts, val) of a stream in order by series: sid, ts, val.

    Times are rounded up to the interval. A buffer holds the newest `window` slots of each series; what falls out of it
    is emitted, older points are dropped, and a second point of a slot is dropped too, or with allow_update replaces the first.
    After `idle` without points a series' buffer is emitted and forgotten, so the state holds live series only.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, newest = state.get if state.exists else ([], [], [-1])
        if state.hasTimedOut:
            state.remove()
            order = np.argsort(times)
            yield _emitted(key[0], np.array(times, np.int64)[order], np.array(values, float)[order])
            return
        slots, vals, interval = _slots(batches)
        # a point is too old by what had come before it
        top = np.maximum.accumulate(np.concatenate([[newest[0]], slots]))
        taken = slots > top[:-1] - window * interval
        slots, vals = np.concatenate([np.array(times, np.int64), slots[taken]]), np.concatenate([np.array(values, float), vals[taken]])
        if allow_update:
            slots, vals = slots[::-1], vals[::-1]
        slots, at = np.unique(slots, return_index=True)  # the first of each slot, in order
        vals, gone = vals[at], slots <= top[-1] - window * interval
        state.update((slots[~gone].tolist(), vals[~gone].tolist(), [int(top[-1])]))
        state.setTimeoutDuration(wait)
        yield _emitted(key[0], slots[gone], vals[gone])

    return points.groupBy("sid").applyInPandasWithState(step, _POINTS, "times array<long>, vals array<double>, newest array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_order(points: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Without a buffer: a point passes at once if its slot is later than all before it in its series, and is dropped otherwise."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        slots, vals, _ = _slots(batches)
        top = np.maximum.accumulate(np.concatenate([[state.get[0] if state.exists else -1], slots]))
        later = slots > top[:-1]
        state.update((int(top[-1]),))
        state.setTimeoutDuration(wait)
        yield _emitted(key[0], slots[later], vals[later])

    return points.groupBy("sid").applyInPandasWithState(step, _POINTS, "newest long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest_batch(metrics: DataFrame, batch: int, index: str, store: str, discarded: str, **limits) -> None:
    """For foreachBatch: good points to the store by day, definitions to the index, discarded rows by reason; limits as for timely().

    Each batch has partitions of its own, which a replay of it replaces.
    """
    checked = timely(validated(metrics), **limits).withColumn("batch", F.lit(batch)).persist()
    good = checked.where("reason IS NULL").drop("reason")

    def put(rows: DataFrame, path: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    put(points_of(good).withColumns({"day": F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"), "batch": F.lit(batch)}), store, "day", "batch")
    put(definitions(good).withColumn("batch", F.lit(batch)), index, "batch")  # read through latest_definitions
    put(checked.where("reason IS NOT NULL"), discarded, "reason", "batch")
    checked.unpersist()


def stored_points(spark: SparkSession, store: str, start: int, end: int) -> DataFrame:
    """sid, ts, val of the store's points after start up to end; only the days of that range are read."""
    day = lambda t: F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy-MM-dd")
    schema = f"{_POINTS}, day string, batch int"
    within = (F.col("day") >= day(start)) & (F.col("day") <= day(end)) & (F.col("ts") > start) & (F.col("ts") <= end)
    return spark.read.schema(schema).parquet(store).where(within).select("sid", "ts", "val")


def latest_definitions(index: DataFrame) -> DataFrame:
    """Each series' newest row: last_update only grows. Written to a new path now and then, it is the index without its history."""
    columns = [c for c in index.columns if c not in ("sid", "batch")]
    return index.groupBy("sid").agg(F.max_by(F.struct(*columns), "last_update").alias("d")).select("sid", "d.*")
