"""Rollups: per span the sum, count, least, greatest and last of the points in (end - span, end], stamped with the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.operators.grid import ceil_to
from gridtide.series import SeriesList

#: Which rollup answers which aggregate.
READ = {"sum": "sum", "count": "cnt", "min": "min", "max": "max", "last": "lst"}


def build(points: DataFrame, spans: list[int]) -> DataFrame:
    """sid, span, ts, sum, cnt, min, max, lst. Longer spans are made from the shortest one, so raw points are read once."""
    spans = sorted(spans)
    seen = points.where("val IS NOT NULL")
    first = seen.groupBy("sid", ceil_to(F.col("ts"), F.lit(spans[0])).alias("end")).agg(F.sum("val").alias("sum"), F.count("val").alias("cnt"), F.min("val").alias("min"), F.max("val").alias("max"), F.max_by("val", "ts").alias("lst"))
    out = None
    for span in spans:
        if span % spans[0]:
            raise ValueError(f"{span} isn't a multiple of {spans[0]}")
        at = first if span == spans[0] else first.groupBy("sid", ceil_to(F.col("end"), F.lit(span)).alias("end")).agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("lst", "end").alias("lst"))
        at = at.select("sid", F.lit(span).alias("span"), F.col("end").alias("ts"), "sum", "cnt", "min", "max", "lst")
        out = at if out is None else out.unionByName(at)
    return out


def read(series: DataFrame, rollups: DataFrame, span: int, how: str) -> SeriesList:
    """A list from the rollups of one span; an average is the sum by the count."""
    at = rollups.where(F.col("span") == span)
    val = F.try_divide("sum", "cnt") if how == "average" else F.col(READ[how]).cast("double")
    return SeriesList.of(series.withColumn("interval", F.lit(span)), at.select("sid", "ts", val.alias("val")))
