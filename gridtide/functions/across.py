"""Functions across series: sums (and others) at each time, over all series or by group."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.aggregates import aggregate, canonical
from gridtide.functions.registry import register
from gridtide.functions.select import one_list
from gridtide.operators.grid import normalize
from gridtide.series import SERIES, SeriesList, key_of, nodes_of


def grouped(sl: SeriesList, key: Column, how: str, x_files_factor: float = 0, *, alone: bool = False, name: Column | None = None, several: bool = False, label: str | None = None) -> SeriesList:
    """One series for each key; partial sums are made where the points are, and only those move.

    Shares and missing values are told by the number of a group's series, whether they have a row at a time or not. alone: the
    only series of a group passes through but for its name. name: of the whole from `patts` (the first pattern, or with
    `several` that of each list that was put together), else the key. label: what tag aggregatedBy says.
    """
    sl = normalize(sl)
    keys = sl.series.withColumn("key", key)
    first = F.struct("ord", "sid")
    size = keys.groupBy("key").agg(
        F.count("*").alias("size"), F.min("ord").alias("ord"), F.min_by(F.struct("interval", "consolidator", "tags"), first).alias("one"),
    )
    on = sl.points.join(keys.join(size.select("key", "size"), "key").select("sid", "key", "ord", "size"), "sid")
    of, seen = F.first("size"), F.count("val")
    val = {
        "avg_zero": lambda: F.coalesce(F.sum("val"), F.lit(0.0)) / of,
        "multiply": lambda: F.when(seen == of, F.product("val")),
    }.get(canonical(how), lambda: aggregate(how, "val", "ord"))()
    if x_files_factor:
        val = F.when((seen > 0) & (seen >= F.lit(x_files_factor) * of), val)
    if alone:
        val = F.when(of == 1, F.max("val")).otherwise(val)
    out = on.groupBy("key", "ts").agg(val.alias("val"))
    # tags that all of a group's series have alike stay
    tags = keys.select("key", F.explode("tags").alias("tag", "value")).groupBy("key", "tag").agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max("value").alias("other"))
    alike = tags.join(size.select("key", "size"), "key").where("n = size AND value = other").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("alike"))
    series = size.join(alike, "key", "left").withColumn("target", F.col("key"))
    if name is not None:
        by_list = keys.groupBy("key", (F.split_part("sid", F.lit("/"), F.lit(1)).cast("int") if several else F.lit(0)).alias("i")).agg(F.min_by("patt", first).alias("patt"))
        patts = by_list.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "patt"))), lambda x: x.patt), ",").alias("patts"))
        series = series.join(patts, "key").withColumn("target", name)
    common = F.coalesce("alike", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(common, lambda k, v: k != "aggregatedBy"), F.create_map(F.lit("aggregatedBy"), F.lit(label or how)))
    merged = F.when(F.map_contains_key(merged, F.lit("name")), merged).otherwise(F.map_concat(merged, F.create_map(F.lit("name"), F.col("target"))))
    if alone:
        merged = F.when(F.col("size") == 1, F.col("one.tags")).otherwise(merged)
    series = series.withColumns({"sid": F.col("key"), "name": F.col("key"), "patt": F.col("target"), "interval": F.col("one.interval"), "consolidator": F.col("one.consolidator"), "tags": merged})
    return replace(sl, series=series.select(*SERIES), points=out.select(F.col("key").alias("sid"), "ts", "val"))


@register("aggregate")
def aggregate_series(*lists: SeriesList | str | float, how: str | None = None, x_files_factor: float = 0, pattern: str | None = None, label: str | None = None) -> SeriesList:
    """All series of the lists into one; missing where the share of values among the series is below x_files_factor.

    After the lists come how and the share, also by position. pattern: what the name says instead of the lists' own patterns.
    """
    more = [x for x in lists if not isinstance(x, SeriesList)]
    how = how or more.pop(0)
    x_files_factor = more.pop(0) if more else x_files_factor
    own = [x for x in lists if isinstance(x, SeriesList)]
    sl = one_list(own)[0]
    name = F.concat(F.lit(f"{label or how}Series("), F.col("patts") if pattern is None else F.lit(pattern), F.lit(")"))
    return grouped(sl, F.lit(f"{label or how}Series"), how, x_files_factor, alone=True, name=name, several=len(own) > 1, label=label)


def _whole(how: str, label: str, *names: str) -> None:
    @register(*names)
    def whole(*lists: SeriesList, pattern: str | None = None) -> SeriesList:
        return aggregate_series(*lists, how=how, pattern=pattern, label=label)


for _how, _label, *_names in (
    ("average", "average", "avg", "averageSeries"), ("diff", "diff", "diffSeries"), ("max", "max", "max", "maxSeries"), ("min", "min", "min", "minSeries"),
    ("multiply", "multiply", "multiplySeries"), ("range", "rangeOf", "rangeOfSeries"), ("stddev", "stddev", "stddevSeries"), ("sum", "sum", "sum", "sumSeries"),
):
    _whole(_how, _label, *_names)


@register("countSeries")
def count_series(*lists: SeriesList, pattern: str | None = None) -> SeriesList:
    """The number of series, at the times of the first one."""
    sl = one_list(lists)[0]
    out = aggregate_series(*lists, how="count", pattern=pattern)
    first = sl.series.orderBy("ord", "sid").limit(1).select("sid")
    n = sl.series.agg(F.count("*").cast("double")).scalar()
    points = sl.points.join(first, "sid", "left_semi").select(F.lit("countSeries").alias("sid"), "ts", n.alias("val"))
    series = out.series.withColumns({"sid": F.lit("countSeries"), "tags": F.create_map(F.lit("name"), F.col("target"))})
    return SeriesList(series.select(*SERIES), points, out.intervals, out.consolidators)


@register("aggregateSeriesWithWildcards")
def with_wildcards(sl: SeriesList, how: str, *positions: int) -> SeriesList:
    """By target without the nodes at the given positions."""
    key = F.array_join(F.filter(nodes_of(F.col("target")), lambda x, i: ~i.isin(*positions)), ".")
    return grouped(sl, key, how, alone=True)


def _wildcards(name: str, how: str) -> None:
    @register(name)
    def wildcards(sl: SeriesList, *positions: int) -> SeriesList:
        return with_wildcards(sl, how, *positions)


for _name, _h in (("averageSeriesWithWildcards", "average"), ("multiplySeriesWithWildcards", "multiply"), ("sumSeriesWithWildcards", "sum")):
    _wildcards(_name, _h)


@register("groupByNodes")
def group_by_nodes(sl: SeriesList, how: str, *nodes: int | str) -> SeriesList:
    """By nodes (numbers, negative ones from the end) and tags' values."""
    return grouped(sl, key_of(F.col("target"), F.col("tags"), list(nodes)), how)


@register("groupByNode")
def group_by_node(sl: SeriesList, node: int | str, how: str = "average") -> SeriesList:
    return group_by_nodes(sl, how, node)


@register("groupByTags")
def group_by_tags(sl: SeriesList, how: str, *tags: str) -> SeriesList:
    """By tags' values: name;t1=v1;...; the name is the function's unless it's asked for, or all series have one."""
    if not tags:
        raise ValueError("no tags")
    name = F.coalesce(F.col("tags")["name"], F.lit(""))
    if "name" not in tags:
        name = sl.series.agg(F.when(F.min(name) == F.max(name), F.min(name)).otherwise(how)).scalar()
    parts = [F.concat(F.lit(f";{t}="), F.coalesce(F.col("tags")[t], F.lit(""))) for t in sorted(set(tags) - {"name"})]
    return grouped(sl, F.concat(name, *parts), how)
