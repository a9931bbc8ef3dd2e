"""Named aggregates: along time for one series, and across series at one time. Nulls are skipped, but by multiply."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

ALIASES = {
    "avg": "average", "current": "last", "lst": "last", "cnt": "count", "mult": "multiply", "med": "median",
    "rangeOf": "range", "total": "sum", "diffSeries": "diff",
}
NAMES = ("average", "count", "last", "min", "max", "multiply", "median", "diff", "stddev", "range", "sum")


def canonical(name: str) -> str:
    name = name.removesuffix("Series")
    name = ALIASES.get(name, name)
    if name not in (*NAMES, "avg_zero"):
        raise ValueError(f"unknown aggregate: {name}")
    return name


def aggregate(name: str, val: str | Column = "val", order: str | Column = "ts") -> Column:
    """For groupBy().agg(); order: what `last` and `diff` go by (time along a series, the list's order across)."""
    name, v, o = canonical(name), F.col(val) if isinstance(val, str) else val, F.col(order) if isinstance(order, str) else order
    seen = F.when(v.isNotNull(), o)  # ordering by null leaves a row out
    return {
        "average": lambda: F.avg(v),
        "avg_zero": lambda: F.coalesce(F.sum(v), F.lit(0.0)) / F.count("*"),
        "count": lambda: F.nullif(F.count(v), F.lit(0)).cast("double"),
        "last": lambda: F.max_by(v, seen),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "multiply": lambda: F.when(F.count(v) == F.count("*"), F.product(v)),
        "median": lambda: F.median(v),
        "diff": lambda: 2 * F.min_by(v, seen) - F.sum(v),
        "stddev": lambda: F.stddev_pop(v),
        "range": lambda: F.max(v) - F.min(v),
        "sum": lambda: F.sum(v),
    }[name]()


def over(name: str, frame: WindowSpec, val: str = "val") -> Column:
    """The aggregate over a window's frame of points of one series."""
    name, v = canonical(name), F.col(val)
    seen = F.when(v.isNotNull(), F.col("ts"))
    return {
        "average": lambda: F.avg(v).over(frame),
        "count": lambda: F.nullif(F.count(v).over(frame), F.lit(0)).cast("double"),
        "last": lambda: F.last(v, ignorenulls=True).over(frame),
        "min": lambda: F.min(v).over(frame),
        "max": lambda: F.max(v).over(frame),
        "multiply": lambda: F.when(F.count(v).over(frame) == F.count("*").over(frame), F.product(v).over(frame)),
        "median": lambda: F.percentile(v, 0.5).over(frame),
        "diff": lambda: 2 * F.min_by(v, seen).over(frame) - F.sum(v).over(frame),
        "stddev": lambda: F.stddev_pop(v).over(frame),
        "range": lambda: F.max(v).over(frame) - F.min(v).over(frame),
        "sum": lambda: F.sum(v).over(frame),
    }[name]()
