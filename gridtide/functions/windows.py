"""Functions along time. Points are dealt out by series once, and windows of one kind share that."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridtide.aggregates import aggregate, over
from gridtide.functions.registry import register, renamed
from gridtide.functions.select import one_list
from gridtide.operators.grid import floor_to
from gridtide.series import SeriesList, finite_or_null, seconds


def _along(sl: SeriesList, val: Column, call: str, **tags: str) -> SeriesList:
    return renamed(sl.with_points(sl.points.withColumn("val", finite_or_null(val))), call, **tags)


def _before(sl: SeriesList) -> Column:
    return F.lag("val").over(sl.by_series())


@register("derivative")
def derivative(sl: SeriesList) -> SeriesList:
    return _along(sl, F.col("val") - _before(sl), "derivative({})", derivative="1")


@register("nonNegativeDerivative")
def non_negative_derivative(sl: SeriesList, max_value: float | None = None) -> SeriesList:
    """Growth; a fall is missing, or a counter's wrap at max_value. A value over max_value counts as missing."""
    if max_value is not None:
        sl = sl.with_points(sl.points.withColumn("val", F.when(F.col("val") <= max_value, F.col("val"))))
    v, p = F.col("val"), _before(sl)
    wrap = F.lit(None) if max_value is None else F.lit(max_value + 1.0) + v - p
    return _along(sl, F.when(v >= p, v - p).when(v < p, wrap), "nonNegativeDerivative({})", nonNegativeDerivative="1")


@register("perSecond")
def per_second(*lists: SeriesList | float, max_value: float | None = None) -> SeriesList:
    """Growth per second, of one list or several together; a last argument that is a number is max_value."""
    sl, max_value = one_list(lists, max_value)
    points = sl.points.join(sl.series.select("sid", "interval"), "sid")
    v, p = F.col("val"), _before(sl)
    wrap = F.lit(None) if not max_value else F.when(v <= max_value, max_value + (v - p) + 1)
    rate = F.when(v >= p, v - p).when(v < p, wrap) / F.col("interval")
    return renamed(sl.with_points(points.withColumn("val", finite_or_null(rate))), "perSecond({})")


@register("integral")
def integral(sl: SeriesList) -> SeriesList:
    total = F.sum("val").over(sl.by_series().rowsBetween(Window.unboundedPreceding, 0))
    return _along(sl, F.when(F.col("val").isNotNull(), total), "integral({})", integral="1")


@register("keepLastValue")
def keep_last_value(sl: SeriesList, limit: int | None = None) -> SeriesList:
    """Fills runs of missing values, if a run isn't longer than limit, with the value before."""
    w = sl.by_series()
    run = sl.points.withColumn("run", F.count("val").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("sid", "run")
    missing = F.count("*").over(in_run) - F.count("val").over(in_run)
    fill = F.max("val").over(in_run)  # a run has one value at most, its first; the run before any has none
    short = F.lit(True) if limit is None else missing <= limit
    return renamed(sl.with_points(run.withColumn("val", F.coalesce("val", F.when(short, fill)))), "keepLastValue({})")


@register("movingWindow")
def moving_window(sl: SeriesList, window: str | int, how: str = "average", x_files_factor: float = 0, start: int | None = None) -> SeriesList:
    """The aggregate of the points in [t - window, t); missing unless there's a value, and so large a share of values. Slots before start are only looked back at."""
    size = seconds(window.lstrip("+-") if isinstance(window, str) else window)
    frame = Window.partitionBy("sid").orderBy("ts").rangeBetween(-size, -1)
    seen, all_ = F.count("val").over(frame), F.count("*").over(frame)
    val = F.when((seen > 0) & (seen >= F.lit(x_files_factor) * all_), over(how, frame))
    points = sl.points.withColumn("val", finite_or_null(val))
    out = sl.with_points(points if start is None else points.where(F.col("ts") >= start))
    name = f"moving{how.capitalize()}"
    return renamed(out, f'{name}({{}},"{window}")', **{name: str(window)})


def _moving(name: str, how: str) -> None:
    @register(name)
    def moving(sl: SeriesList, window: str | int, x_files_factor: float = 0, start: int | None = None) -> SeriesList:
        return moving_window(sl, window, how, x_files_factor, start)


for _name, _how in (("movingAverage", "average"), ("movingMax", "max"), ("movingMedian", "median"), ("movingMin", "min"), ("movingSum", "sum")):
    _moving(_name, _how)


@register("offsetToZero")
def offset_to_zero(sl: SeriesList) -> SeriesList:
    return _along(sl, F.col("val") - F.min("val").over(Window.partitionBy("sid")), "offsetToZero({})", offsetToZero="1")


@register("minMax")
def min_max(sl: SeriesList) -> SeriesList:
    """(v - least) / (greatest - least), 0 if those are equal."""
    w = Window.partitionBy("sid")
    low, high = F.min("val").over(w), F.max("val").over(w)
    return _along(sl, F.when(F.col("val").isNotNull() & (high == low), 0.0).otherwise((F.col("val") - low) / (high - low)), "minMax({})", minMax="1")


def _percentile(sl: SeriesList, n: float, above: bool, call: str) -> SeriesList:
    """By nearest rank, from counts of values: the least value with so many at or below it. Series without values go."""
    by_val = sl.points.where("val IS NOT NULL").groupBy("sid", "val").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sid")
    ranked = by_val.withColumns({"upto": F.sum("n").over(w.orderBy("val").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    rank = F.least(F.ceil(F.lit(n / 100.0) * (F.col("all") + 1)), F.col("all"))
    limit = ranked.where(F.col("upto") >= rank).groupBy("sid").agg(F.min("val").alias("limit"))
    ok = F.col("val") <= F.col("limit") if above else F.col("val") >= F.col("limit")
    kept = sl.points.join(limit, "sid").withColumn("val", F.when(ok, F.col("val")))
    return renamed(sl.with_series(sl.series.join(limit, "sid", "left_semi")).with_points(kept), call, nPercentile=f"{n:g}")


@register("removeAbovePercentile")
def remove_above_percentile(sl: SeriesList, n: float) -> SeriesList:
    return _percentile(sl, n, True, f"removeAbovePercentile({{}}, {n:g})")


@register("removeBelowPercentile")
def remove_below_percentile(sl: SeriesList, n: float) -> SeriesList:
    return _percentile(sl, n, False, f"removeBelowPercentile({{}}, {n:g})")


@register("linearRegression")
def linear_regression(sl: SeriesList, source_start: int | None = None, source_end: int | None = None) -> SeriesList:
    """The least-squares line of each series' points from source_start up to source_end, at all of its slots; series without a line go."""
    bounds = "" if source_start is None and source_end is None else f", {source_start}, {source_end}"
    source = sl.points
    if source_start is not None:
        source = source.where(F.col("ts") >= source_start)
    if source_end is not None:
        source = source.where(F.col("ts") < source_end)
    # sums about each series' first slot keep the numbers small
    first = source.groupBy("sid").agg(F.min("ts").alias("t0"))
    on = source.join(first, "sid").join(sl.series.select("sid", "interval"), "sid").withColumn("i", (F.col("ts") - F.col("t0")) / F.col("interval")).where("val IS NOT NULL")
    s = on.groupBy("sid").agg(F.first("t0").alias("t0"), F.first("interval").alias("interval"), F.count("*").alias("n"), F.sum("i").alias("si"), F.sum(F.col("i") * F.col("i")).alias("sii"), F.sum("val").alias("sv"), F.sum(F.col("i") * F.col("val")).alias("siv"))
    under = F.col("n") * F.col("sii") - F.col("si") * F.col("si")
    line = s.where(under != 0).select("sid", "t0", "interval", ((F.col("n") * F.col("siv") - F.col("si") * F.col("sv")) / under).alias("slope"), ((F.col("sii") * F.col("sv") - F.col("siv") * F.col("si")) / under).alias("base"))
    out = sl.points.join(line, "sid").withColumn("val", F.col("base") + F.col("slope") * (F.col("ts") - F.col("t0")) / F.col("interval"))
    return renamed(sl.with_series(sl.series.join(line, "sid", "left_semi")).with_points(out), f"linearRegression({{}}{bounds})", linearRegressions=bounds[2:])


@register("timeShift")
def time_shift(sl: SeriesList, shift: str) -> SeriesList:
    """Points of an earlier time (or, with a +, a later one) shown at the present one; the list holds the shifted range."""
    shift = shift if shift[0] in "+-" else f"-{shift}"
    by = seconds(shift[1:]) * (1 if shift[0] == "+" else -1)
    return renamed(sl.with_points(sl.points.withColumn("ts", F.col("ts") - F.lit(by))), f'timeShift({{}}, "{shift}")', timeShift=shift)


@register("summarize")
def summarize(sl: SeriesList, interval: str, how: str = "sum", align_to_from: bool = False, start: int | None = None) -> SeriesList:
    """Buckets [b, b + interval) stamped with their beginning, at multiples of the interval or from each series' first point on; empty ones between are null. Buckets that begin before start go."""
    size = seconds(interval)
    points = sl.points
    if align_to_from:
        points = points.withColumn("base", F.min("ts").over(Window.partitionBy("sid")))
        slot = F.col("base") + floor_to(F.col("ts") - F.col("base"), F.lit(size))
    else:
        slot = floor_to(F.col("ts"), F.lit(size))
    sums = points.groupBy("sid", slot.alias("slot")).agg(aggregate(how).alias("val"))
    ends = sums.groupBy("sid").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = ends.select("sid", F.explode(F.sequence("lo", "hi", F.lit(size).cast("long"))).alias("slot"))
    out = grid.join(sums, ["sid", "slot"], "left").select("sid", F.col("slot").alias("ts"), "val")
    out = out if start is None else out.where(F.col("ts") >= start)
    call = f'summarize({{}}, "{interval}", "{how}"' + (", true)" if align_to_from else ")")
    out_list = sl.with_series(sl.series.withColumn("interval", F.lit(size)), intervals=frozenset({size})).with_points(out)
    return renamed(out_list, call, summarize=interval, summarizeFunction=how)


@register("smartSummarize")
def smart_summarize(sl: SeriesList, interval: str, how: str = "sum", align_to_from: bool = False) -> SeriesList:
    """Returns its input, as there is no engine behind this name."""
    return sl
