"""Functions of names and of consolidators: the series table only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.aggregates import canonical
from gridtide.functions.registry import register, renamed
from gridtide.functions.select import _checked
from gridtide.series import SeriesList, key_of, metric_of, nodes_of


def _target(sl: SeriesList, col: Column, tag: bool = True) -> SeriesList:
    """Another name, which is the pattern too, and with `tag` the tag `name`."""
    series = sl.series.withColumns({"target": col, "patt": col})
    return sl.with_series(series.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, v: k != "name"), F.create_map(F.lit("name"), F.col("target")))) if tag else series)


@register("alias")
def alias(sl: SeriesList, name: str) -> SeriesList:
    return _target(sl, F.lit(name))


@register("aliasByNode", "aliasByTags")
def alias_by_node(sl: SeriesList, *nodes: int | str) -> SeriesList:
    return _target(sl, key_of(F.col("target"), F.col("tags"), list(nodes)))


@register("aliasByMetric")
def alias_by_metric(sl: SeriesList) -> SeriesList:
    """The last node; ;tags stay."""
    return _target(sl, F.concat(F.element_at(nodes_of(F.col("target")), -1), F.regexp_extract("target", r"(;[^(),]*)", 1)), tag=False)


@register("aliasSub")
def alias_sub(sl: SeriesList, search: str, replacement: str) -> SeriesList:
    r"""Replaces in the metric; \1 is the first group."""
    return _target(sl, F.regexp_replace(metric_of(F.col("target")), _checked(search), re.sub(r"\\(\d)", r"$\1", replacement)))


@register("substr")
def substr(sl: SeriesList, start: int = 0, stop: int = 0) -> SeriesList:
    """Nodes start up to stop (0: to the end; negative ones from the end), bounds being taken for each series."""
    nodes = nodes_of(F.col("target"))
    n = F.size(nodes)
    first = F.greatest(F.lit(0), n + start if start < 0 else F.lit(start))
    last = n if stop == 0 else F.least(n, n + stop if stop < 0 else F.lit(stop))
    return _target(sl, F.array_join(F.slice(nodes, first + 1, F.greatest(F.lit(0), last - first)), "."), tag=False)


@register("consolidateBy")
def consolidate_by(sl: SeriesList, how: str) -> SeriesList:
    """How points are consolidated later, and which rollup is read."""
    out = sl.with_series(sl.series.withColumn("consolidator", F.lit(canonical(how))), consolidators=frozenset({canonical(how)}))
    return renamed(out, f'consolidateBy({{}},"{how}")')


@register("cumulative")
def cumulative(sl: SeriesList) -> SeriesList:
    return consolidate_by(sl, "sum")
