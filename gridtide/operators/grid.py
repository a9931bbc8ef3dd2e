"""Grids: quantizing raw points, common intervals, consolidation to a number of points, merging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.aggregates import aggregate
from gridtide.series import SERIES, SeriesList


def ceil_to(ts, interval):
    """The end of the slot (t - interval, t] that a time is in."""
    return (F.ceil(ts / interval) * interval).cast("long")


def floor_to(ts, interval):
    return (F.floor(ts / interval) * interval).cast("long")


def quantize(series: DataFrame, raw: DataFrame, start: int, end: int) -> SeriesList:
    """Raw points (sid, ts, val) on each series' grid: a slot has its earliest point; slots from start up to end (exclusive), absent ones null."""
    whole = SeriesList.of(series, raw)
    on = whole.points.join(whole.series.select("sid", "interval"), "sid").where((F.col("ts") > F.lit(start) - F.col("interval")) & (F.col("ts") < end))
    slots = on.groupBy("sid", ceil_to(F.col("ts"), F.col("interval")).alias("slot")).agg(F.min_by("val", "ts").alias("val"))
    return whole.with_points(slots.select("sid", F.col("slot").alias("ts"), "val")).dense(start, end - 1)


def by_consolidator(sl: SeriesList) -> Column:
    """The aggregate that each series' consolidator names, of those that the list's series have."""
    names = sl.known_consolidators()
    if len(names) == 1:
        return aggregate(names[0])
    value = F.lit(None).cast("double")
    for n in names:
        value = F.when(F.first("consolidator") == n, aggregate(n)).otherwise(value)
    return value


def normalize(sl: SeriesList, interval: int | None = None) -> SeriesList:
    """All series at the common interval, each by its consolidator, stamped with the end of the bucket; a last bucket that isn't full is left out."""
    own = sl.known_intervals()
    interval = interval or math.lcm(*own or [1])
    if all(i == interval for i in own):
        return sl
    on = sl.points.join(sl.series.select("sid", "consolidator", F.col("interval").alias("_i")), "sid").withColumn("slot", ceil_to(F.col("ts"), F.lit(interval)))
    out = on.groupBy("sid", "slot").agg(by_consolidator(sl).alias("val"), F.max("ts").alias("_last"))
    # a bucket is full if the series goes on to its end
    last = F.max("_last").over(Window.partitionBy("sid"))
    out = out.withColumn("_last", last).where(F.col("slot") <= F.col("_last"))
    return sl.with_series(sl.series.withColumn("interval", F.lit(interval)), intervals=frozenset({interval})).with_points(out.select("sid", F.col("slot").alias("ts"), "val"))


def consolidate(sl: SeriesList, max_points: int, nudge: bool = True) -> SeriesList:
    """At most max_points points a series: runs of k slots become one by the consolidator, stamped with the run's last slot.

    With nudge, the first slots that don't fill a run at a multiple of its length are left out when there are enough,
    so that runs stay the same as time goes on.
    """
    w = Window.partitionBy("sid")
    on = sl.points.join(sl.series.select("sid", "interval", "consolidator"), "sid")
    on = on.withColumns({"n": F.count("*").over(w), "first": F.min("ts").over(w), "i": F.row_number().over(w.orderBy("ts")) - 1})
    on = on.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(max_points))))
    long = F.col("k") * F.col("interval")
    skip = F.when(F.lit(nudge) & (F.col("k") > 1) & (F.col("n") > 2 * F.col("k")), F.pmod(-(F.col("first") - F.col("interval")), long) / F.col("interval")).otherwise(0).cast("long")
    on = on.withColumn("skip", skip).where(F.col("i") >= F.col("skip")).withColumn("run", F.floor((F.col("i") - F.col("skip")) / F.col("k")))
    runs = on.groupBy("sid", "run").agg(by_consolidator(sl).alias("val"), (F.min("ts") + (F.first("k") - 1) * F.first("interval")).cast("long").alias("ts"))
    k = on.groupBy("sid").agg(F.first("k").alias("k"))
    series = sl.series.join(k, "sid", "left").withColumn("interval", (F.col("interval") * F.coalesce("k", F.lit(1))).cast("int"))
    return sl.with_series(series, intervals=None).with_points(runs)


def merge_series(sl: SeriesList) -> SeriesList:
    """Series of one target become one, at their common interval; at each time the first in order that has a value gives it."""
    sl = normalize(sl)
    one = sl.series.groupBy("target").agg(F.min_by(F.struct(*SERIES), F.struct("ord", "sid")).alias("s")).select("s.*")
    to = sl.series.join(one.select("target", F.col("sid").alias("into")), "target").select("sid", "into", "ord")
    on = sl.points.join(to, "sid").groupBy(F.col("into").alias("sid"), "ts").agg(F.min_by("val", F.when(F.col("val").isNotNull(), F.struct("ord", "sid"))).alias("val"))
    return sl.with_series(one).with_points(on)
