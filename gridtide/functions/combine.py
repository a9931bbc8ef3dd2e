"""Functions of two lists."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.functions.across import aggregate_series, grouped
from gridtide.functions.registry import called, register
from gridtide.operators.grid import normalize
from gridtide.series import SERIES, SeriesList, finite_or_null, key_of


def _together(a: SeriesList, b: SeriesList) -> tuple[SeriesList, SeriesList]:
    interval = math.lcm(*a.known_intervals(), *b.known_intervals())
    return normalize(a, interval), normalize(b, interval)


def _named(pairs: Column | str, call: str, other: Column) -> Column:
    return F.concat(F.lit(f"{call}("), pairs, F.lit(","), F.coalesce(other, F.lit("MISSING")), F.lit(")"))


def _paired(a: SeriesList, b: SeriesList, pairs: DataFrame, val: Column, call: str) -> SeriesList:
    """pairs: sid, other (null: none), other_target, other_patt. val is of v and w, the values of the pair at one time. The tag `name` alone is left."""
    on = a.points.join(pairs, "sid").join(b.points.select(F.col("sid").alias("other"), "ts", F.col("val").alias("w")), ["other", "ts"], "left")
    series = a.series.join(pairs, "sid").withColumns({"target": _named("target", call, F.col("other_target")), "patt": _named("patt", call, F.col("other_patt"))})
    series = series.withColumn("tags", F.create_map(F.lit("name"), F.col("target")))
    return a.with_series(series).with_points(on.select("sid", "ts", finite_or_null(val).alias("val")))


def _with_one(a: SeriesList, b: SeriesList, needs_one: str) -> DataFrame:
    """Pairs of each series of a with the only one of b; an error, when the result is read, if b has none or more."""
    one = b.series.agg(F.when(F.count("*") == 1, F.any_value(F.struct("sid", "target", "patt"))).otherwise(F.raise_error(F.lit(needs_one)).cast("struct<sid:string,target:string,patt:string>"))).scalar()
    return a.series.select("sid", one.alias("one")).select("sid", F.col("one.sid").alias("other"), F.col("one.target").alias("other_target"), F.col("one.patt").alias("other_patt"))


def _ratio() -> Column:
    return F.try_divide("val", "w")


@register("divideSeries")
def divide_series(dividends: SeriesList, divisor: SeriesList) -> SeriesList:
    """Each series by the one divisor; missing where that is 0."""
    dividends, divisor = _together(dividends, divisor)
    return _paired(dividends, divisor, _with_one(dividends, divisor, "divideSeries needs exactly one divisor"), _ratio(), "divideSeries")


def _by_place(a: DataFrame, b: DataFrame, order: str, one_for_all: bool = False) -> DataFrame:
    """Pairs of the first with the first, and so on (with one_for_all, all with the first where b has only one); an error, when the result is read, if the lists differ in length. One task numbers the series (not their points)."""
    at = lambda x: x.withColumn("_at", F.row_number().over(Window.orderBy(order, "sid")))
    one, two = at(a).select("sid", "_at"), at(b).select(F.col("sid").alias("other"), F.col("target").alias("other_target"), F.col("patt").alias("other_patt"), "_at")
    if one_for_all:
        one = one.withColumn("_at", F.when(b.agg(F.count("*") == 1).scalar(), 1).otherwise(F.col("_at")))
    unlike = F.col("sid").isNull() | F.col("other").isNull()
    checked = F.when(unlike, F.raise_error(F.lit("lists of different lengths")).cast("string")).otherwise(F.col("sid"))
    return one.join(two, "_at", "full").select(checked.alias("sid"), "other", "other_target", "other_patt")


@register("divideSeriesLists")
def divide_series_lists(dividends: SeriesList, divisors: SeriesList) -> SeriesList:
    """The first by the first, and so on; the lists must be of one length."""
    dividends, divisors = _together(dividends, divisors)
    return _paired(dividends, divisors, _by_place(dividends.series, divisors.series, "ord"), _ratio(), "divideSeries")


@register("asPercent")
def as_percent(sl: SeriesList, total: float | SeriesList | None = None, *nodes: int | str) -> SeriesList:
    """Values in hundredths of a total: a number, one series, a list matched by sorted target, the sum of the list itself, or by nodes the sum of the group (of the list, or of the total's series)."""
    share = _ratio() * 100
    if nodes:
        if isinstance(total, int | float):
            raise ValueError("with nodes, the total is none or a list")
        other = sl if total is None else total
        sl, other = _together(sl, other)
        key = key_of(F.col("target"), F.col("tags"), list(nodes))
        sums = grouped(other, key, "sum")
        total_name = F.concat(F.lit("sumSeries("), "target", F.lit(")"))
        named = sums.series.select(F.col("sid").alias("other"), total_name.alias("other_target"), total_name.alias("other_patt"))
        pairs = sl.series.select("sid", key.alias("key")).join(named, F.col("key") == F.col("other"), "left").drop("key")
        out = _paired(sl, sums, pairs, share, "asPercent")
        # groups of the total that have no series here are shown without values
        alone = sums.series.join(pairs.select(F.col("other").alias("sid")), "sid", "left_anti")
        series = alone.withColumns({"target": F.concat(F.lit("asPercent(MISSING,"), total_name, F.lit(")")), "sid": F.concat(F.lit("MISSING/"), "sid")})
        series = series.withColumns({"patt": F.col("target"), "tags": F.create_map(F.lit("name"), F.col("target"))})
        points = sums.points.join(alone.select("sid"), "sid", "left_semi").select(F.concat(F.lit("MISSING/"), "sid").alias("sid"), "ts", F.lit(None).cast("double").alias("val"))
        return replace(out, series=out.series.unionByName(series.select(*SERIES)), points=out.points.unionByName(points))
    if isinstance(total, int | float):
        val = F.try_divide(F.col("val"), F.lit(float(total))) * 100
        series = sl.series.withColumns({c: called(c, f"asPercent({{}},{total:g})") for c in ("target", "patt")})
        return sl.with_series(series.withColumn("tags", F.create_map(F.lit("name"), F.col("target")))).with_points(sl.points.withColumn("val", val))
    if total is None:
        sl = normalize(sl)
        total = aggregate_series(sl, how="sum")
        return _paired(sl, total, _with_one(sl, total, "asPercent needs series"), share, "asPercent")
    sl, total = _together(sl, total)
    return _paired(sl, total, _by_place(sl.series, total.series, "target", one_for_all=True), share, "asPercent")


@register("constantLine")
def constant_line(spark: SparkSession, value: float, start: int, end: int) -> SeriesList:
    """A line of up to three points from start to end."""
    times = sorted({start, start + (end - start) // 2, end})
    series = spark.createDataFrame([(f"{value:g}", f"{value:g}", {"name": f"{value:g}"}, max(1, (end - start) // 2))], "sid string, name string, tags map<string,string>, interval int").withColumn("patt", F.lit(f"{value:g}"))
    return SeriesList.of(series, spark.createDataFrame([(f"{value:g}", t, float(value)) for t in times], "sid string, ts long, val double"))
