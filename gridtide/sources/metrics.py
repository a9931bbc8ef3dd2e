"""Metric definitions and points from tables, text lines and messages; validation; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.operators.grid import ceil_to
from gridtide.series import SeriesList
from gridtide.shared import written

#: A metric message: metadata and one value.
METRIC = T.StructType(
    [
        T.StructField("org", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("interval", T.IntegerType()), T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()), T.StructField("time", T.LongType()), T.StructField("mtype", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
MTYPES = ("gauge", "rate", "count", "counter", "timestamp")
MAX_TIME = (1 << 31) - 1


def series_id(org: Column, name: Column, unit: Column, mtype: Column, interval: Column, tags: Column) -> Column:
    """Identity of a series: name, unit, kind, interval and sorted tags; a `name=` tag isn't part of it."""
    own = F.array_sort(F.filter(tags, lambda t: ~t.startswith("name=")))
    return F.concat_ws(".", org.cast("string"), F.md5(F.concat_ws("\0", name, unit, mtype, interval.cast("string"), F.array_join(own, "\0"))))


def tags_map(name: Column, tags: Column) -> Column:
    """Tags "k=v" as a map, with the name (without leading ~) as tag `name`."""
    pairs = F.transform(F.filter(tags, lambda t: ~t.startswith("name=")), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substring(t, F.instr(t, "=") + F.lit(1), F.length(t)).alias("value")))
    return F.map_concat(F.map_from_entries(pairs), F.create_map(F.lit("name"), F.regexp_replace(name, "^~+", "")))


def carbon_lines(lines: DataFrame, column: str = "value", org: int = 1, interval: int = 10) -> DataFrame:
    """Lines `name[;tag=value...] value time` as metric rows; a line of another form has a null name."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    path = F.split(F.get(parts, F.lit(0)), ";")
    ok = F.size(parts) == 3
    return lines.select(
        F.lit(org).alias("org"),
        F.when(ok, F.get(path, F.lit(0))).alias("name"),
        F.lit(interval).alias("interval"),
        F.get(parts, F.lit(1)).try_cast("double").alias("value"),
        F.lit("unknown").alias("unit"),
        F.get(parts, F.lit(2)).try_cast("double").cast("long").alias("time"),
        F.lit("gauge").alias("mtype"),
        F.slice(path, 2, F.greatest(F.lit(0), F.size(path) - 1)).alias("tags"),
    )


def json_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages in JSON as metric rows (for batches and for streams)."""
    return messages.select(F.from_json(F.col(column).cast("string"), METRIC).alias("m")).select("m.*")


def validated(metrics: DataFrame) -> DataFrame:
    """metrics with `reason`: null for good rows, else why a row is discarded."""
    bad_tag = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~t.rlike("^[^;!^=~][^;!^=]*=[^;~][^;]*$"))
    reason = (
        F.when(F.col("org").isNull() | (F.col("org") == 0), "invalid-org")
        .when(F.col("interval").isNull() | (F.col("interval") <= 0), "invalid-interval")
        .when(F.col("name").isNull() | (F.col("name") == ""), "invalid-name")
        .when(~F.coalesce(F.col("mtype").isin(*MTYPES), F.lit(False)), "invalid-mtype")
        .when(bad_tag, "invalid-tag")
        .when(F.col("time").isNull() | (F.col("time") <= 0) | (F.col("time") >= MAX_TIME), "invalid-time")
        .when(F.col("value").isNull(), "invalid-value")
    )
    return metrics.withColumn("reason", reason)


def definitions(metrics: DataFrame) -> DataFrame:
    """One row for each series: sid, org, name, interval, unit, mtype, tags (map) and last_update."""
    own = metrics.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    sid = series_id(F.col("org"), F.col("name"), F.coalesce("unit", F.lit("")), F.col("mtype"), F.col("interval"), F.col("tags"))
    by = own.withColumn("sid", sid).groupBy("sid").agg(*[F.any_value(c).alias(c) for c in ("org", "name", "interval", "unit", "mtype", "tags")], F.max("time").alias("last_update"))
    return by.withColumn("tags", tags_map(F.col("name"), F.col("tags")))


def points_of(metrics: DataFrame) -> DataFrame:
    """sid, ts, val."""
    sid = series_id(F.col("org"), F.col("name"), F.coalesce("unit", F.lit("")), F.col("mtype"), F.col("interval"), F.coalesce("tags", F.array().cast("array<string>")))
    return metrics.select(sid.alias("sid"), F.col("time").alias("ts"), F.col("value").alias("val"))


def series_from_table(df: DataFrame, name: Column, at: Column, value: Column, interval: int, tags: dict[str, Column] | None = None, patt: str = "*") -> SeriesList:
    """Sums of a table's values by series and slot (as a rollup of counts), exact for values of two decimals; dense.

    This is the fetch: the table is read once, and what it is reduced to, points and series apart, is kept in the shared folder, with the times of its first and last slots.
    """
    tags = {"name": name} if tags is None else {"name": name, **tags}
    seconds = F.unix_timestamp(at) if not isinstance(at, int) else at
    on = df.select(name.alias("sid"), ceil_to(seconds, F.lit(interval)).alias("ts"), value.cast("decimal(18,2)").alias("v"), *[c.alias(f"t_{k}") for k, c in tags.items()])
    own = [f"t_{k}" for k in tags]
    reduced = on.groupBy("sid", "ts").agg(F.sum("v").cast("double").alias("val"), *[F.any_value(t).alias(t) for t in own])
    reduced = written(reduced, "fetched")
    series = reduced.groupBy("sid").agg(*[F.any_value(t).alias(t) for t in own])
    series = series.select("sid", F.col("sid").alias("name"), F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*map(F.col, own))).alias("tags"), F.lit(interval).alias("interval"), F.lit(patt).alias("patt"))
    return SeriesList.of(written(series, "series"), reduced, [interval]).dense()


def combined(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Points of two stores: cold ones count before each series' first hot one."""
    first = hot.groupBy("sid").agg(F.min("ts").alias("_first"))
    old = cold.join(first, "sid", "left").where(F.col("_first").isNull() | (F.col("ts") < F.col("_first")))
    return hot.select("sid", "ts", "val").unionByName(old.select("sid", "ts", "val"))


def resampled(points: DataFrame, interval: int, to: int, how: str = "average") -> DataFrame:
    """An archive at another resolution: finer by repeating each value over its slots, coarser by an aggregate."""
    from gridtide.aggregates import aggregate

    if to < interval:
        times = F.sequence(F.col("ts") - F.lit(interval) + F.lit(to), F.col("ts"), F.lit(to).cast("long"))
        return points.select("sid", F.explode(times).alias("ts"), "val")
    return points.groupBy("sid", ceil_to(F.col("ts"), F.lit(to)).alias("at")).agg(aggregate(how).alias("val")).select("sid", F.col("at").alias("ts"), "val")


def to_json(sl: SeriesList) -> DataFrame:
    """target, json: {"target", "tags", "datapoints": [[value, time], ...]}, one row a series."""
    points = sl.points.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("ts", "val"))).alias("p"))
    rows = sl.series.join(points, "sid", "left")
    data = F.transform(F.coalesce("p", F.array().cast("array<struct<ts:bigint,val:double>>")), lambda p: F.concat(F.lit("["), F.coalesce(p.val.cast("string"), F.lit("null")), F.lit(","), p.ts.cast("string"), F.lit("]")))
    head = F.to_json(F.struct("target", "tags"))
    return rows.select("target", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"datapoints":['), F.array_join(data, ","), F.lit("]}")).alias("json"))


def to_csv(sl: SeriesList) -> DataFrame:
    """target, time (UTC), value: for write.csv; missing values are empty."""
    return sl.rows().select("target", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("val").cast("string").alias("value"))


def synthetic(spark, series: int, points: int, interval: int = 10, start: int = 0) -> DataFrame:
    """Made-up metric rows: a wave for each of so many series."""
    ids = spark.range(series * points).select((F.col("id") % series).alias("s"), F.floor(F.col("id") / series).alias("i"))
    return ids.select(F.lit(1).alias("org"), F.concat(F.lit("some.id."), F.col("s").cast("string")).alias("name"), F.lit(interval).alias("interval"), (F.sin(F.col("i") / 10.0 + F.col("s")) * 100).alias("value"), F.lit("ms").alias("unit"), (F.lit(start) + (F.col("i") + 1) * interval).cast("long").alias("time"), F.lit("gauge").alias("mtype"), F.array().cast("array<string>").alias("tags"))
