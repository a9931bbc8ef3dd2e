"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.spaces import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and its neighbours v. The minimum is taken before rows meet, so a node of any degree is cheap."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(m, "u").withColumn("m", F.least("u", "m"))


def components(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (its least node) for every node in pairs (two columns of one type; order, loops and repeats don't matter). Each round's edges are a table in scratch, of which the last stays."""
    scratch = scratch or Scratch(pairs.sparkSession, "components")
    a, b = pairs.columns
    loops = pairs.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component"))
    edges = scratch.written(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go below
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _least(down)
        small = starred.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).distinct()
        smaller = scratch.written(small, "edges")
        scratch.drop(edges)
        edges = smaller
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
