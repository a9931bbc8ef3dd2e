"""Functions of one value at a time: a projection over points, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.functions.registry import register, renamed
from gridtide.series import SeriesList, finite_or_null


def _map(sl: SeriesList, val: Column, call: str, needs_interval: bool = False, **tags: str) -> SeriesList:
    points = sl.points.join(sl.series.select("sid", "interval"), "sid") if needs_interval else sl.points
    return renamed(sl.with_points(points.withColumn("val", finite_or_null(val))), call, **tags)


@register("absolute")
def absolute(sl: SeriesList) -> SeriesList:
    return _map(sl, F.abs("val"), "absolute({})", absolute="1")


@register("invert")
def invert(sl: SeriesList) -> SeriesList:
    """1 / v; missing for 0."""
    return _map(sl, F.try_divide(F.lit(1.0), F.col("val")), "invert({})", invert="1")


@register("log", "logarithmic")
def log(sl: SeriesList, base: float = 10) -> SeriesList:
    """Missing for values of 0 or less."""
    if base <= 0 or base == 1:
        raise ValueError("base must be over 0 and not 1")
    return _map(sl, F.when(F.col("val") > 0, F.ln("val") / F.lit(math.log(base))), f"log({{}},{base:g})", log=f"{base:g}")


@register("offset")
def offset(sl: SeriesList, by: float) -> SeriesList:
    return _map(sl, F.col("val") + F.lit(float(by)), f"offset({{}},{by:g})")


@register("scale")
def scale(sl: SeriesList, by: float) -> SeriesList:
    return _map(sl, F.col("val") * F.lit(float(by)), f"scale({{}},{by:g})")


def _half_away(v: Column, digits: int) -> Column:
    return F.round(v * F.lit(10.0**digits)) / F.lit(10.0**digits)


@register("scaleToSeconds")
def scale_to_seconds(sl: SeriesList, seconds: float) -> SeriesList:
    """The value per so many seconds, to six decimals."""
    return _map(sl, _half_away(F.col("val") * F.lit(float(seconds)) / F.col("interval"), 6), f"scaleToSeconds({{}},{int(seconds)})", True, scaleToSeconds=f"{seconds:g}")


@register("round")
def round_(sl: SeriesList, precision: int = 0) -> SeriesList:
    """Halves away from zero; infinities stay."""
    v = F.col("val")
    return _map(sl, F.when(F.abs(v) == float("inf"), v).otherwise(_half_away(v, precision)), f"round({{}},{precision})", round=str(precision))


@register("isNonNull")
def is_non_null(sl: SeriesList) -> SeriesList:
    """1 where there's a value, else 0; for dense lists."""
    return _map(sl, F.col("val").isNotNull().cast("double"), "isNonNull({})", isNonNull="1")


@register("transformNull")
def transform_null(sl: SeriesList, default: float | None = None) -> SeriesList:
    """0 by default, of which the name then says nothing."""
    return _map(sl, F.coalesce("val", F.lit(float(default or 0))), "transformNull({})" if default is None else f"transformNull({{}},{default:g})")


@register("removeAboveValue")
def remove_above_value(sl: SeriesList, n: float) -> SeriesList:
    return _map(sl, F.when(F.col("val") <= n, F.col("val")), f"removeAboveValue({{}}, {n:g})")


@register("removeBelowValue")
def remove_below_value(sl: SeriesList, n: float) -> SeriesList:
    return _map(sl, F.when(F.col("val") >= n, F.col("val")), f"removeBelowValue({{}}, {n:g})")
