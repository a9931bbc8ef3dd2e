"""The series list: two DataFrames that every function takes and returns.

series: sid (string), ord (string, the list's order), target, name, tags (map), interval (seconds), consolidator, patt (the pattern that the series was asked for by, in all calls so far).
points: sid, ts (seconds, a multiple of the interval), val (double; null: missing).

A list also carries, where it was known when the list was fetched, which intervals and consolidators its series have, so that
functions needn't ask: they run no jobs, and a request is one plan from the fetched points to its result.

Functions on metadata (names, sorting, selection) never touch points; functions on
points keep series as they are. Points are stored by grid: between a list's first and last
slot each series has every slot once, when `dense` was applied (sources do so).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["sid", "ord", "target", "name", "tags", "interval", "consolidator", "patt"]
POINTS = ["sid", "ts", "val"]

_UNITS = {"s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800, "mon": 2592000, "month": 2592000, "months": 2592000, "y": 31536000, "year": 31536000, "years": 31536000}


def seconds(duration: str | int) -> int:
    """'5min', '1h30min' or a number of seconds."""
    if isinstance(duration, int):
        return duration
    parts = re.findall(r"(\d+)([a-zA-Z]*)", duration)
    if not parts or "".join(a + b for a, b in parts) != duration:
        raise ValueError(f"not a duration: {duration!r}")
    try:
        return sum(int(n) * _UNITS[u.lower() if u else "s"] for n, u in parts)
    except KeyError as e:
        raise ValueError(f"not a duration: {duration!r}") from e


def finite_or_null(v: Column) -> Column:
    """Missing values are null here; NaN never is stored. Infinities are values."""
    return F.when(~F.isnan(v), v)


@dataclass(frozen=True)
class SeriesList:
    series: DataFrame
    points: DataFrame
    intervals: frozenset[int] | None = None
    consolidators: frozenset[str] | None = None

    @staticmethod
    def of(series: DataFrame, points: DataFrame, intervals: Iterable[int] | None = None) -> SeriesList:
        """From a table with sid, name, tags and interval; targets are names, and the order is that of targets. intervals: those that occur, if known."""
        add = {"target": F.col("name"), "ord": F.col("name"), "consolidator": F.lit("average"), "patt": F.lit("*")}
        own = None if "consolidator" in series.columns else frozenset({"average"})
        series = series.withColumns({k: v for k, v in add.items() if k not in series.columns})
        points = points.select("sid", F.col("ts").cast("long").alias("ts"), finite_or_null(F.col("val").cast("double")).alias("val"))
        return SeriesList(series.select(*SERIES), points, None if intervals is None else frozenset(intervals), own)

    def with_points(self, points: DataFrame) -> SeriesList:
        return replace(self, points=points.select(*POINTS))

    def with_series(self, series: DataFrame, **known) -> SeriesList:
        return replace(self, series=series.select(*SERIES), **known)

    def only(self, series: DataFrame) -> SeriesList:
        """The part of the list whose series are given."""
        return replace(self, series=series.select(*SERIES), points=self.points.join(series.select("sid"), "sid", "left_semi").select(*POINTS))

    def known_intervals(self) -> list[int]:
        """The intervals that occur; asked of the series (of few values) if they weren't known at fetch."""
        return sorted(self.intervals if self.intervals is not None else [r.interval for r in self.series.select("interval").distinct().collect()])

    def known_consolidators(self) -> list[str]:
        return sorted(self.consolidators if self.consolidators is not None else [r.consolidator for r in self.series.select("consolidator").distinct().collect()])

    def dense(self, start: int | None = None, end: int | None = None) -> SeriesList:
        """Every slot from start to end (inclusive; the list's own first and last if not given, for which the points are asked), absent ones as null."""
        if start is None or end is None:
            own = self.points.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
            start, end = own.lo if start is None else start, own.hi if end is None else end
        if start is None or end is None:
            return self
        first = (F.ceil(F.lit(start) / F.col("interval")) * F.col("interval")).cast("long")
        grid = self.series.where(first <= end).select("sid", F.explode(F.sequence(first, F.lit(end).cast("long"), F.col("interval").cast("long"))).alias("ts"))
        return self.with_points(grid.join(self.points, ["sid", "ts"], "left"))

    def rows(self, digits: int | None = None) -> DataFrame:
        """target, ts, val: the list as one table."""
        val = F.col("val") if digits is None else F.round("val", digits)
        return self.points.join(self.series.select("sid", "target"), "sid").select("target", "ts", val.alias("val"))

    def by_series(self) -> Window:
        return Window.partitionBy("sid").orderBy("ts")


def nodes_of(text: Column) -> Column:
    """The dot-separated nodes of a target's metric: what stands innermost in calls, without ;tags."""
    return F.split(metric_of(text), r"\.")


def metric_of(text: Column) -> Column:
    """The metric in a target such as f(g(a.b.c, 1), 2): a.b.c."""
    inner = F.regexp_extract(text, r"^(?:[^(]*\()*([^(),]+)", 1)
    return F.split_part(F.trim(inner), F.lit(";"), F.lit(1))


def key_of(target: Column, tags: Column, nodes: list[int | str]) -> Column:
    """The nodes (numbers, negative ones from the end) and tags' values that exist, joined by dots."""
    parts = nodes_of(target)
    picked = [F.get(parts, F.when(F.lit(n) < 0, F.size(parts) + n).otherwise(F.lit(n))) if isinstance(n, int) else tags[n] for n in nodes]
    return F.array_join(F.array_compact(F.array(*picked)), ".")
