"""Choosing and ordering series: by score, by name, by presence of values."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.aggregates import aggregate
from gridtide.functions.registry import register
from gridtide.series import SERIES, SeriesList

_OPERATORS = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


def one_list(lists, number: float | None = None) -> tuple[SeriesList, float | None]:
    """Several lists as one, in order, and the number behind them if there is one."""
    *lists, last = lists
    if not isinstance(last, SeriesList):
        number = last
    else:
        lists.append(last)
    return lists[0] if len(lists) == 1 else group(*lists), number


def scores(sl: SeriesList, how: str) -> DataFrame:
    """The series with the aggregate of their points as score; null without values."""
    return sl.series.join(sl.points.groupBy("sid").agg(aggregate(how).alias("score")), "sid", "left")


@register("filterSeries")
def filter_series(sl: SeriesList, how: str, operator: str, threshold: float) -> SeriesList:
    """A series without values passes < and <=, and !=."""
    passes = _OPERATORS[operator](F.col("score"), F.lit(float(threshold)))
    return sl.only(scores(sl, how).where(F.coalesce(passes, F.lit(operator in ("<", "<=", "!=")))))


def _threshold(name: str, how: str, operator: str) -> None:
    @register(name)
    def threshold_filter(sl: SeriesList, threshold: float) -> SeriesList:
        return filter_series(sl, how, operator, threshold)


for _prefix, _how in (("average", "average"), ("current", "last"), ("maximum", "max"), ("minimum", "min")):
    _threshold(f"{_prefix}Above", _how, ">")
    _threshold(f"{_prefix}Below", _how, "<=")


def _numbered(series: DataFrame, *order: Column) -> DataFrame:
    """ord by the given order: series are sorted by ranges, and numbers grow from range to range (they aren't consecutive)."""
    return series.orderBy(*order).withColumn("ord", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))


def _by_score(reverse: bool) -> list[Column]:
    return [F.col("score").desc_nulls_last() if reverse else F.col("score").asc_nulls_first(), F.col("ord"), F.col("sid")]


@register("highest")
def highest(sl: SeriesList, n: int, how: str = "average") -> SeriesList:
    return sl.only(_numbered(scores(sl, how).orderBy(*_by_score(True)).limit(n), *_by_score(True)))


@register("lowest")
def lowest(sl: SeriesList, n: int, how: str = "average") -> SeriesList:
    """Series without values come first."""
    return sl.only(_numbered(scores(sl, how).orderBy(*_by_score(False)).limit(n), *_by_score(False)))


def _extreme(name: str, base, how: str) -> None:
    @register(name)
    def extreme(sl: SeriesList, n: int) -> SeriesList:
        return base(sl, n, how)


for _name, _base, _h in (("highestAverage", highest, "average"), ("highestCurrent", highest, "last"), ("highestMax", highest, "max"), ("lowestAverage", lowest, "average"), ("lowestCurrent", lowest, "last")):
    _extreme(_name, _base, _h)


@register("sortBy")
def sort_by(sl: SeriesList, how: str, reverse: bool = False) -> SeriesList:
    return sl.with_series(_numbered(scores(sl, how), *_by_score(reverse)))


@register("sortByMaxima")
def sort_by_maxima(sl: SeriesList) -> SeriesList:
    return sort_by(sl, "max", True)


@register("sortByTotal")
def sort_by_total(sl: SeriesList) -> SeriesList:
    return sort_by(sl, "sum", True)


@register("sortByName")
def sort_by_name(sl: SeriesList, natural: bool = False, reverse: bool = False) -> SeriesList:
    """natural: numbers in names by their value."""
    key = F.col("target")
    if natural:
        parts = F.regexp_extract_all("target", F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
        key = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 24, "0")).otherwise(p)), "")
    return sl.with_series(_numbered(sl.series.withColumn("_k", key), F.col("_k").desc() if reverse else F.col("_k").asc(), F.col("ord"), F.col("sid")))


def _checked(pattern: str) -> str:
    if any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!")):
        raise ValueError("look-around isn't supported in patterns")
    return pattern


@register("grep")
def grep(sl: SeriesList, pattern: str) -> SeriesList:
    return sl.only(sl.series.where(F.col("target").rlike(_checked(pattern))))


@register("exclude")
def exclude(sl: SeriesList, pattern: str) -> SeriesList:
    return sl.only(sl.series.where(~F.col("target").rlike(_checked(pattern))))


@register("group")
def group(*lists: SeriesList) -> SeriesList:
    """The lists one after the other; a series of two lists is in the result twice."""
    tagged = [
        SeriesList(x.series.withColumns({"sid": F.concat(F.lit(f"{i}/"), "sid"), "ord": F.concat(F.lit(f"{i:06d}/"), "ord")}).select(*SERIES), x.points.withColumn("sid", F.concat(F.lit(f"{i}/"), "sid")))
        for i, x in enumerate(lists)
    ]
    known = [None if any(getattr(x, what) is None for x in lists) else frozenset().union(*[getattr(x, what) for x in lists]) for what in ("intervals", "consolidators")]
    return SeriesList(reduce(DataFrame.unionByName, [x.series for x in tagged]), reduce(DataFrame.unionByName, [x.points for x in tagged]), *known)


@register("unique")
def unique(*lists: SeriesList) -> SeriesList:
    """The first series of each target."""
    all_ = group(*lists) if len(lists) > 1 else lists[0]
    return all_.only(all_.series.groupBy("target").agg(F.min_by(F.struct(*SERIES), F.struct("ord", "sid")).alias("s")).select("s.*"))


@register("fallbackSeries")
def fallback_series(sl: SeriesList, fallback: SeriesList) -> SeriesList:
    """The other list if this one has no series; which of them is told when the result is read."""
    both = group(sl, fallback)
    nothing = sl.series.agg(F.count("*") == 0).scalar()
    own = lambda rows: rows.where(F.col("sid").startswith("0/") | nothing)
    return replace(both, series=own(both.series), points=own(both.points))


@register("removeEmptySeries")
def remove_empty_series(sl: SeriesList, x_files_factor: float = 0) -> SeriesList:
    kept = sl.points.groupBy("sid").agg(F.count("val").alias("n"), F.count("*").alias("of")).where((F.col("n") > 0) & (F.col("n") >= F.lit(x_files_factor) * F.col("of")))
    return sl.only(sl.series.join(kept, "sid", "left_semi"))


@register("removeZeroSeries")
def remove_zero_series(sl: SeriesList, x_files_factor: float = 0) -> SeriesList:
    """Missing values count as other than zero."""
    other = F.count_if(F.col("val").isNull() | (F.col("val") != 0))
    kept = sl.points.groupBy("sid").agg(other.alias("n"), F.count("*").alias("of")).where((F.col("n") > 0) & (F.col("n") >= F.lit(x_files_factor) * F.col("of")))
    return sl.only(sl.series.join(kept, "sid", "left_semi"))
