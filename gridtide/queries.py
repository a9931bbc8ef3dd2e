"""The query catalogue: every function and operator over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.functions import across, combine, naming, pointwise, select, windows
from gridtide.functions.registry import apply
from gridtide.operators import grid, index, rollup
from gridtide.plans.retention import StorageRule
from gridtide.requests import Store, render
from gridtide.series import SeriesList
from gridtide.sources import metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6

DAY, HOUR = 86400, 3600


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- base lists -------------------------------------------------------------------------------


def orders(spark: SparkSession, d: str) -> SeriesList:
    """Daily sums of prices: orders.<status>.<priority>."""
    t = _read(spark, d, "orders")
    priority = F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))
    name = F.concat_ws(".", F.lit("orders"), F.col("o_orderstatus"), priority)
    return metrics.series_from_table(t, name, F.col("o_orderdate"), F.col("o_totalprice"), DAY, {"name": F.lit("orders"), "status": F.col("o_orderstatus"), "priority": priority})


def sales(spark: SparkSession, d: str) -> SeriesList:
    """Daily sums of quantities: sales.<returnflag>.<linestatus>."""
    t = _read(spark, d, "lineitem")
    name = F.concat_ws(".", F.lit("sales"), F.col("l_returnflag"), F.col("l_linestatus"))
    return metrics.series_from_table(t, name, F.col("l_shipdate"), F.col("l_quantity"), DAY, {"name": F.lit("sales"), "flag": F.col("l_returnflag"), "line": F.col("l_linestatus")})


def events(spark: SparkSession, d: str) -> SeriesList:
    """Hourly sums of values: events.<type>."""
    t = _read(spark, d, "events")
    return metrics.series_from_table(t, F.concat(F.lit("events."), F.col("event_type")), F.col("ts"), F.col("value"), HOUR, {"name": F.lit("events"), "type": F.col("event_type")})


def _base(table: str, target: str, at: str, value: str, interval: int, tags: tuple[str, ...]) -> str:
    return f"""
WITH raw AS (
  SELECT {target} AS target, {", ".join(tags)}, CAST(ceil(floor(epoch({at})) / {interval}.0) AS BIGINT) * {interval} AS ts, CAST(sum(CAST({value} AS DECIMAL(18, 2))) AS DOUBLE) AS val
  FROM {table} GROUP BY ALL),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM raw),
k AS (SELECT DISTINCT target, {", ".join(x.split(" AS ")[1] for x in tags)} FROM raw),
S AS (
  SELECT k.*, g.ts, raw.val FROM (SELECT k.target, unnest(range(lo, hi + {interval}, {interval})) AS ts FROM k, b) g
  JOIN k USING (target) LEFT JOIN raw ON raw.target = g.target AND raw.ts = g.ts)"""


BASES = {
    "orders": (orders, _base("orders", "'orders.' || o_orderstatus || '.' || replace(o_orderpriority, ' ', '_')", "o_orderdate", "o_totalprice", DAY, ("o_orderstatus AS status", "replace(o_orderpriority, ' ', '_') AS priority"))),
    "sales": (sales, _base("lineitem", "'sales.' || l_returnflag || '.' || l_linestatus", "l_shipdate", "l_quantity", DAY, ("l_returnflag AS flag", "l_linestatus AS line"))),
    "events": (events, _base("events", "'events.' || event_type", "ts", "value", HOUR, ("event_type AS type",))),
}


def _rounded(sl: SeriesList, digits: int = DIGITS) -> DataFrame:
    rows = sl.rows()
    return rows.withColumn("val", F.round("val", digits) + F.lit(0.0))


def add(name: str, base: str, f: Callable[[SeriesList], SeriesList], sql: str, more: str = "", digits: int = DIGITS) -> None:
    """sql: a SELECT of target, ts, val from S (and from `more`, further WITH parts)."""
    load, with_ = BASES[base]
    QUERIES[name] = lambda spark, d: _rounded(f(load(spark, d)), digits)
    SQL[name] = f"{with_}{', ' + more if more else ''}, r AS ({sql}) SELECT target, ts, round(CAST(val AS DOUBLE), {digits}) + 0.0 AS val FROM r"


# ---- across series ----------------------------------------------------------------------------

_AGG = {
    "average": "avg(val)", "avg_zero": "coalesce(sum(val), 0.0) / count(*)", "min": "min(val)", "max": "max(val)", "sum": "sum(val)", "median": "median(val)", "stddev": "stddev_pop(val)",
    "range": "max(val) - min(val)", "count": "CAST(nullif(count(val), 0) AS DOUBLE)", "last": "arg_max(val, target) FILTER (val IS NOT NULL)", "diff": "2 * arg_min(val, target) FILTER (val IS NOT NULL) - sum(val)",
    "multiply": "CASE WHEN count(val) = count(*) THEN product(val) END",
}

for _how, _expr in _AGG.items():
    _list, _cut = ("sales", (lambda sl: pointwise.scale(sl, 0.001))) if _how == "multiply" else ("orders", (lambda sl: sl))
    _scaled = _expr.replace("product(val)", "product(val * 0.001)")
    _patt = "scale(*,0.001)" if _how == "multiply" else "*"
    add(f"aggregate_{_how}", _list, lambda sl, h=_how, c=_cut: across.aggregate_series(c(sl), h), f"SELECT '{_how}Series({_patt})' AS target, ts, {_scaled} AS val FROM S GROUP BY ts")

for _fn, _how in (("avg", "average"), ("averageSeries", "average"), ("sum", "sum"), ("sumSeries", "sum"), ("min", "min"), ("minSeries", "min"), ("max", "max"), ("maxSeries", "max"), ("diffSeries", "diff"), ("stddevSeries", "stddev"), ("rangeOfSeries", "range")):
    add(f"fn_{_fn}", "events", lambda sl, n=_fn: apply(n, sl), f"SELECT '{'rangeOf' if _how == 'range' else _how}Series(*)' AS target, ts, {_AGG[_how]} AS val FROM S GROUP BY ts")
add("fn_multiplySeries", "events", lambda sl: apply("multiplySeries", pointwise.scale(sl, 0.01)), "SELECT 'multiplySeries(scale(*,0.01))' AS target, ts, CASE WHEN count(val) = count(*) THEN product(val * 0.01) END AS val FROM S GROUP BY ts")
add("aggregate_xff", "orders", lambda sl: across.aggregate_series(sl, "sum", 0.5), "SELECT 'sumSeries(*)' AS target, ts, CASE WHEN count(val) / count(*) >= 0.5 THEN sum(val) END AS val FROM S GROUP BY ts")
add("fn_countSeries", "orders", lambda sl: apply("countSeries", sl), "SELECT 'countSeries(*)' AS target, ts, (SELECT count(DISTINCT target) FROM S) AS val FROM S WHERE target = (SELECT min(target) FROM S)")
add("fn_groupByNode", "orders", lambda sl: apply("groupByNode", sl, 1, "sum"), "SELECT status AS target, ts, sum(val) AS val FROM S GROUP BY ALL")
add("fn_groupByNodes", "orders", lambda sl: apply("groupByNodes", sl, "average", 0, -1), "SELECT 'orders.' || priority AS target, ts, avg(val) AS val FROM S GROUP BY ALL")
add("group_by_nodes_and_tags", "orders", lambda sl: apply("groupByNodes", sl, "max", "status", 0), "SELECT status || '.orders' AS target, ts, max(val) AS val FROM S GROUP BY ALL")
add("fn_groupByTags", "orders", lambda sl: apply("groupByTags", sl, "sum", "priority"), "SELECT 'orders;priority=' || priority AS target, ts, sum(val) AS val FROM S GROUP BY ALL")
for _fn, _how in (("sumSeriesWithWildcards", "sum"), ("averageSeriesWithWildcards", "average")):
    add(f"fn_{_fn}", "orders", lambda sl, n=_fn: apply(n, sl, 1), f"SELECT 'orders.' || priority AS target, ts, {_AGG[_how]} AS val FROM S GROUP BY ALL")
add("fn_multiplySeriesWithWildcards", "sales", lambda sl: apply("multiplySeriesWithWildcards", naming.alias_sub(pointwise.scale(sl, 0.001), "^", ""), 1), "SELECT 'sales.' || line AS target, ts, CASE WHEN count(val) = count(*) THEN product(val * 0.001) END AS val FROM S GROUP BY ALL", digits=9)
add("fn_aggregateSeriesWithWildcards", "orders", lambda sl: apply("aggregateSeriesWithWildcards", sl, "median", 2), "SELECT 'orders.' || status AS target, ts, median(val) AS val FROM S GROUP BY ALL")

# ---- one value --------------------------------------------------------------------------------


def _call(call: str) -> str:
    before, after = call.split("{}")
    return f"'{before}' || target || '{after}'"


for _fn, _args, _call_, _expr in (
    ("absolute", (), "absolute({})", "abs(val)"),
    ("invert", (), "invert({})", "1.0 / nullif(val, 0)"),
    ("log", (10,), "log({},10)", "CASE WHEN val > 0 THEN ln(val) / ln(10.0) END"),
    ("logarithmic", (2,), "log({},2)", "CASE WHEN val > 0 THEN ln(val) / ln(2.0) END"),
    ("offset", (12.5,), "offset({},12.5)", "val + 12.5"),
    ("scale", (0.25,), "scale({},0.25)", "val * 0.25"),
    ("scaleToSeconds", (60,), "scaleToSeconds({},60)", "round(val * 60 / 3600 * 1e6) / 1e6"),
    ("round", (1,), "round({},1)", "round(val * 10) / 10"),
    ("isNonNull", (), "isNonNull({})", "CASE WHEN val IS NULL THEN 0.0 ELSE 1.0 END"),
    ("transformNull", (-1,), "transformNull({},-1)", "coalesce(val, -1.0)"),
    ("removeAboveValue", (2000,), "removeAboveValue({}, 2000)", "CASE WHEN val <= 2000 THEN val END"),
    ("removeBelowValue", (2000,), "removeBelowValue({}, 2000)", "CASE WHEN val >= 2000 THEN val END"),
):
    add(f"fn_{_fn}", "events", lambda sl, n=_fn, a=_args: apply(n, sl, *a), f"SELECT {_call(_call_)} AS target, ts, {_expr} AS val FROM S")

# ---- along time -------------------------------------------------------------------------------

_W = "(PARTITION BY target ORDER BY ts)"
for _fn, _args, _call_, _expr in (
    ("derivative", (), "derivative({})", f"val - lag(val) OVER {_W}"),
    ("nonNegativeDerivative", (), "nonNegativeDerivative({})", f"CASE WHEN val >= lag(val) OVER {_W} THEN val - lag(val) OVER {_W} END"),
    ("perSecond", (), "perSecond({})", f"CASE WHEN val >= lag(val) OVER {_W} THEN (val - lag(val) OVER {_W}) / {DAY} END"),
    ("integral", (), "integral({})", f"CASE WHEN val IS NOT NULL THEN sum(val) OVER {_W} END"),
    ("offsetToZero", (), "offsetToZero({})", "val - min(val) OVER (PARTITION BY target)"),
    ("minMax", (), "minMax({})", "CASE WHEN val IS NOT NULL AND max(val) OVER w = min(val) OVER w THEN 0.0 ELSE (val - min(val) OVER w) / (max(val) OVER w - min(val) OVER w) END"),
):
    _window = " WINDOW w AS (PARTITION BY target)" if "OVER w" in _expr else ""
    add(f"fn_{_fn}", "orders", lambda sl, n=_fn, a=_args: apply(n, sl, *a), f"SELECT {_call(_call_)} AS target, ts, {_expr} AS val FROM S{_window}", digits=3 if _fn == "integral" else DIGITS)

add(
    "non_negative_derivative_wrap", "events", lambda sl: windows.non_negative_derivative(sl, 5000),
    f"SELECT 'nonNegativeDerivative(' || target || ')' AS target, ts, CASE WHEN v >= p THEN v - p WHEN v < p THEN 5001 + v - p END AS val FROM (SELECT target, ts, v, lag(v) OVER {_W} AS p FROM (SELECT target, ts, CASE WHEN val <= 5000 THEN val END AS v FROM S))",
)
add(
    "fn_keepLastValue", "orders", lambda sl: windows.keep_last_value(sl, 2),
    "SELECT 'keepLastValue(' || target || ')' AS target, ts, coalesce(val, CASE WHEN count(*) OVER (PARTITION BY target, run) - count(val) OVER (PARTITION BY target, run) <= 2 THEN max(val) OVER (PARTITION BY target, run) END) AS val "
    f"FROM (SELECT target, ts, val, count(val) OVER {_W} AS run FROM S)",
)
add("several_lists", "sales", lambda sl: apply("sum", select.grep(sl, "\\.F$"), pointwise.scale(sl, 2)), "SELECT 'sumSeries(*,scale(*,2))' AS target, ts, sum(v) AS val FROM (SELECT ts, val AS v FROM S WHERE line = 'F' UNION ALL SELECT ts, val * 2 FROM S) GROUP BY ts")
for _fn in ("stddevSeries", "rangeOfSeries", "avg"):
    add(f"one_series_{_fn}", "sales", lambda sl, n=_fn: apply(n, select.grep(sl, "A.F")), f"SELECT '{dict(avg='averageSeries').get(_fn, _fn)}(*)' AS target, ts, val FROM S WHERE target LIKE '%A.F'")
for _fn, _how in (("movingAverage", "average"), ("movingMax", "max"), ("movingMin", "min"), ("movingMedian", "median"), ("movingSum", "sum")):
    add(f"fn_{_fn}", "orders", lambda sl, n=_fn: apply(n, sl, "7d"), f"SELECT 'moving{_how.capitalize()}(' || target || ',\"7d\")' AS target, ts, {_AGG[_how]} OVER (PARTITION BY target ORDER BY ts RANGE BETWEEN {7 * DAY} PRECEDING AND 1 PRECEDING) AS val FROM S")
add("fn_movingWindow", "events", lambda sl: windows.moving_window(sl, "5h", "range", 0.5), f"SELECT 'movingRange(' || target || ',\"5h\")' AS target, ts, CASE WHEN count(val) OVER w >= 0.5 * count(*) OVER w AND count(val) OVER w > 0 THEN max(val) OVER w - min(val) OVER w END AS val FROM S WINDOW w AS (PARTITION BY target ORDER BY ts RANGE BETWEEN {5 * HOUR} PRECEDING AND 1 PRECEDING)")
for _fn, _op in (("removeAbovePercentile", "<="), ("removeBelowPercentile", ">=")):
    add(
        f"fn_{_fn}", "orders", lambda sl, n=_fn: apply(n, sl, 90 if "Above" in n else 10),
        f"SELECT '{_fn}(' || target || ', {90 if 'Above' in _fn else 10})' AS target, ts, CASE WHEN val {_op} p THEN val END AS val FROM S JOIN p USING (target)",
        f"p AS (SELECT target, v[CAST(least(ceil({0.9 if 'Above' in _fn else 0.1} * (len(v) + 1)), len(v)) AS BIGINT)] AS p FROM (SELECT target, list_sort(list(val) FILTER (val IS NOT NULL)) AS v FROM S GROUP BY target) WHERE len(v) > 0)",
    )
add(
    "fn_linearRegression", "events", lambda sl: windows.linear_regression(sl),
    "SELECT 'linearRegression(' || target || ')' AS target, ts, base + slope * (ts - t0) / 3600 AS val FROM S JOIN l USING (target)",
    "l AS (SELECT target, t0, regr_slope(val, (ts - t0) / 3600) AS slope, regr_intercept(val, (ts - t0) / 3600) AS base FROM (SELECT *, min(ts) OVER (PARTITION BY target) AS t0 FROM S) GROUP BY ALL)",
)
add("fn_timeShift", "events", lambda sl: windows.time_shift(sl, "1d"), f"SELECT 'timeShift(' || target || ', \"-1d\")' AS target, ts + {DAY} AS ts, val FROM S")
for _how in ("sum", "average", "max", "last"):
    _e = _AGG[_how].replace("target)", "ts)")
    add(f"summarize_{_how}", "events", lambda sl, h=_how: windows.summarize(sl, "1d", h), f"SELECT 'summarize(' || target || ', \"1d\", \"{_how}\")' AS target, ts // {DAY} * {DAY} AS ts, {_e} AS val FROM S GROUP BY target, S.ts // {DAY} * {DAY}")
add("summarize_from_first", "events", lambda sl: windows.summarize(sl, "7h", "sum", True), f"SELECT 'summarize(' || target || ', \"7h\", \"sum\", true)' AS target, lo + (t - lo) // {7 * HOUR} * {7 * HOUR} AS ts, sum(val) AS val FROM (SELECT target, S.ts AS t, val, min(S.ts) OVER (PARTITION BY target) AS lo FROM S) GROUP BY ALL")
add("fn_smartSummarize", "events", lambda sl: apply("smartSummarize", sl, "1d"), "SELECT target, ts, val FROM S")

# ---- choosing, ordering -----------------------------------------------------------------------


def _scored(how: str) -> str:
    return f"sc AS (SELECT target, {_AGG[how].replace('target)', 'ts)')} AS score FROM S GROUP BY target)"


def _mean_score(sl: SeriesList, how: str) -> float:
    """A threshold that the data gives: the mean of the series' scores."""
    return select.scores(sl, how).agg(F.avg("score")).first()[0]


for _fn, _how, _op in (
    ("averageAbove", "average", ">"), ("averageBelow", "average", "<="), ("currentAbove", "last", ">"), ("currentBelow", "last", "<="),
    ("maximumAbove", "max", ">"), ("maximumBelow", "max", "<="), ("minimumAbove", "min", ">"), ("minimumBelow", "min", "<="),
):
    add(f"fn_{_fn}", "orders", lambda sl, n=_fn, h=_how: apply(n, sl, _mean_score(sl, h)), f"SELECT target, ts, val FROM S SEMI JOIN (SELECT target FROM sc WHERE score {_op} (SELECT avg(score) FROM sc)) USING (target)", _scored(_how))
add("fn_filterSeries", "orders", lambda sl: apply("filterSeries", sl, "stddev", ">=", _mean_score(sl, "stddev")), "SELECT target, ts, val FROM S SEMI JOIN (SELECT target FROM sc WHERE score >= (SELECT avg(score) FROM sc)) USING (target)", _scored("stddev"))
for _fn, _how, _dir in (("highestAverage", "average", "DESC NULLS LAST"), ("highestCurrent", "last", "DESC NULLS LAST"), ("highestMax", "max", "DESC NULLS LAST"), ("lowestAverage", "average", "ASC NULLS FIRST"), ("lowestCurrent", "last", "ASC NULLS FIRST")):
    add(f"fn_{_fn}", "orders", lambda sl, n=_fn: apply(n, sl, 3), f"SELECT target, ts, val FROM S SEMI JOIN (SELECT target FROM sc ORDER BY score {_dir}, target LIMIT 3) USING (target)", _scored(_how))
add("fn_highest", "orders", lambda sl: apply("highest", sl, 4, "sum"), "SELECT target, ts, val FROM S SEMI JOIN (SELECT target FROM sc ORDER BY score DESC NULLS LAST, target LIMIT 4) USING (target)", _scored("sum"))
add("fn_lowest", "orders", lambda sl: apply("lowest", sl, 4, "min"), "SELECT target, ts, val FROM S SEMI JOIN (SELECT target FROM sc ORDER BY score ASC NULLS FIRST, target LIMIT 4) USING (target)", _scored("min"))


def _ordered(name: str, f: Callable[[SeriesList], SeriesList], how: str | None, order: str) -> None:
    """Sorting shows in the series' order: target, place."""
    QUERIES[name] = lambda spark, d: f(orders(spark, d)).series.select("target", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))
    with_ = BASES["orders"][1]
    SQL[name] = f"{with_}, {_scored(how or 'sum')} SELECT target, row_number() OVER (ORDER BY {order}) AS place FROM sc"


_ordered("fn_sortBy", lambda sl: apply("sortBy", sl, "average"), "average", "score ASC NULLS FIRST, target")
_ordered("fn_sortByMaxima", lambda sl: apply("sortByMaxima", sl), "max", "score DESC NULLS LAST, target")
_ordered("fn_sortByTotal", lambda sl: apply("sortByTotal", sl), "sum", "score DESC NULLS LAST, target")
_ordered("fn_sortByName", lambda sl: apply("sortByName", sl, reverse=True), None, "target DESC")

add("fn_grep", "orders", lambda sl: apply("grep", sl, "URGENT|LOW$"), "SELECT target, ts, val FROM S WHERE regexp_matches(target, 'URGENT|LOW$')")
add("fn_exclude", "orders", lambda sl: apply("exclude", sl, r"\.F\."), r"SELECT target, ts, val FROM S WHERE NOT regexp_matches(target, '\.F\.')")
add("fn_group", "sales", lambda sl: select.group(sl, naming.alias_by_node(sl, 1, 2)), "SELECT target, ts, val FROM S UNION ALL SELECT flag || '.' || line, ts, val FROM S")
add("fn_unique", "sales", lambda sl: select.unique(sl, sl), "SELECT target, ts, val FROM S")
add("fn_fallbackSeries", "sales", lambda sl: select.fallback_series(select.grep(sl, "nothing"), sl), "SELECT target, ts, val FROM S")
add("fn_removeEmptySeries", "orders", lambda sl: apply("removeEmptySeries", sl, 0.02), "SELECT target, ts, val FROM S SEMI JOIN (SELECT target FROM S GROUP BY target HAVING count(val) > 0 AND count(val) >= 0.02 * count(*)) USING (target)")
add("fn_removeZeroSeries", "sales", lambda sl: apply("removeZeroSeries", pointwise.transform_null(sl), 0.1), "SELECT 'transformNull(' || target || ')' AS target, ts, coalesce(val, 0.0) AS val FROM S SEMI JOIN (SELECT target FROM S GROUP BY target HAVING count(*) FILTER (coalesce(val, 0) <> 0) >= 0.1 * count(*)) USING (target)")

# ---- two lists --------------------------------------------------------------------------------

add(
    "fn_divideSeries", "orders", lambda sl: combine.divide_series(sl, across.aggregate_series(sl, "sum")),
    "SELECT 'divideSeries(' || target || ',sumSeries(*))' AS target, S.ts, val / nullif(w, 0) AS val FROM S JOIN (SELECT ts, sum(val) AS w FROM S GROUP BY ts) USING (ts)",
)
add(
    "fn_divideSeriesLists", "orders", lambda sl: combine.divide_series_lists(sl, pointwise.offset(sl, 1)),
    "SELECT 'divideSeries(' || target || ',offset(' || target || ',1))' AS target, ts, val / (val + 1) AS val FROM S",
)
add("as_percent_of_sum", "orders", lambda sl: combine.as_percent(sl), "SELECT 'asPercent(' || target || ',sumSeries(*))' AS target, ts, val / nullif(sum(val) OVER (PARTITION BY ts), 0) * 100 AS val FROM S")
add("as_percent_of_number", "orders", lambda sl: combine.as_percent(sl, 250000), "SELECT 'asPercent(' || target || ',250000)' AS target, ts, val / 250000 * 100 AS val FROM S")
add("as_percent_of_series", "orders", lambda sl: combine.as_percent(sl, across.aggregate_series(sl, "max")), "SELECT 'asPercent(' || target || ',maxSeries(*))' AS target, ts, val / nullif(max(val) OVER (PARTITION BY ts), 0) * 100 AS val FROM S")
add("as_percent_of_list", "sales", lambda sl: combine.as_percent(sl, pointwise.scale(sl, 4)), "SELECT 'asPercent(' || target || ',scale(' || target || ',4))' AS target, ts, val / nullif(val * 4, 0) * 100 AS val FROM S")
add("as_percent_of_group", "orders", lambda sl: combine.as_percent(sl, None, 1), "SELECT 'asPercent(' || target || ',sumSeries(' || status || '))' AS target, ts, val / nullif(sum(val) OVER (PARTITION BY status, ts), 0) * 100 AS val FROM S")
add(
    "as_percent_of_group_list", "orders", lambda sl: combine.as_percent(select.exclude(sl, "URGENT"), select.exclude(sl, "LOW"), 2),
    "SELECT CASE WHEN priority LIKE '%LOW%' THEN 'asPercent(' || target || ',MISSING)' ELSE 'asPercent(' || target || ',sumSeries(' || priority || '))' END AS target, ts, CASE WHEN priority NOT LIKE '%LOW%' THEN val / nullif(sum(val) OVER (PARTITION BY priority, ts), 0) * 100 END AS val FROM S WHERE priority NOT LIKE '%URGENT%' "
    "UNION ALL SELECT DISTINCT 'asPercent(MISSING,sumSeries(' || priority || '))', ts, CAST(NULL AS DOUBLE) FROM S WHERE priority LIKE '%URGENT%'",
)
QUERIES["fn_constantLine"] = lambda spark, d: _rounded(combine.constant_line(spark, 12.5, 100, 200))
SQL["fn_constantLine"] = "SELECT '12.5' AS target, CAST(unnest([100, 150, 200]) AS BIGINT) AS ts, CAST(12.5 AS DOUBLE) AS val"

# ---- names ------------------------------------------------------------------------------------

for _name, _f, _expr in (
    ("alias", lambda sl: apply("alias", sl, "all"), "'all'"),
    ("aliasByNode", lambda sl: apply("aliasByNode", sl, 2, 0), "priority || '.orders'"),
    ("aliasByTags", lambda sl: apply("aliasByTags", sl, "status", "missing", -1), "status || '.' || priority"),
    ("aliasByMetric", lambda sl: apply("aliasByMetric", pointwise.absolute(sl)), "priority"),
    ("aliasSub", lambda sl: apply("aliasSub", sl, r"^orders\.(.)\.(.*)$", r"\2_of_\1"), "priority || '_of_' || status"),
    ("substr", lambda sl: apply("substr", pointwise.absolute(sl), 1, 3), "status || '.' || priority"),
    ("consolidateBy", lambda sl: apply("consolidateBy", sl, "max"), "'consolidateBy(' || target || ',\"max\")'"),
    ("cumulative", lambda sl: apply("cumulative", sl), "'consolidateBy(' || target || ',\"sum\")'"),
):
    _v = "abs(val)" if _name in ("aliasByMetric", "substr") else "val"
    add(f"fn_{_name}", "orders", _f, f"SELECT {_expr} AS target, ts, {_v} AS val FROM S")

# ---- grids and rollups ------------------------------------------------------------------------

_RUN = """n AS (SELECT target, val, ts, count(*) OVER w AS n, min(ts) OVER w AS f, row_number() OVER (PARTITION BY target ORDER BY ts) - 1 AS i FROM S WINDOW w AS (PARTITION BY target)),
k AS (SELECT *, CAST(greatest(1, ceil(n / 100.0)) AS BIGINT) AS k FROM n),
z AS (SELECT *, CASE WHEN k > 1 AND n > 2 * k THEN ((-(f - 3600) % (k * 3600)) + k * 3600) % (k * 3600) // 3600 ELSE 0 END AS s FROM k),
u AS (SELECT target, val, ts, k, (i - s) // k AS u FROM z WHERE i >= s)"""
for _how in ("average", "sum", "max", "last"):
    _e = _AGG[_how].replace("target)", "ts)")
    add(f"consolidate_{_how}", "events", lambda sl, h=_how: grid.consolidate(naming.consolidate_by(sl, h), 100), f"SELECT 'consolidateBy(' || target || ',\"{_how}\")' AS target, min(u.ts) + (any_value(k) - 1) * 3600 AS ts, {_e.replace('ts)', 'u.ts)')} AS val FROM u GROUP BY target, u", _RUN.replace("k AS (SELECT *,", "k2 AS (SELECT *,").replace("FROM k)", "FROM k2)"))
add("normalize_week", "orders", lambda sl: grid.normalize(sl, 7 * DAY), f"SELECT target, ceil(ts / {7 * DAY}.0)::BIGINT * {7 * DAY} AS ts, avg(val) AS val FROM S GROUP BY target, ceil(S.ts / {7 * DAY}.0)::BIGINT * {7 * DAY} HAVING ceil(min(S.ts) / {7 * DAY}.0)::BIGINT * {7 * DAY} <= (SELECT max(ts) FROM S)")
add("merge_series", "sales", lambda sl: grid.merge_series(naming.alias_by_node(sl, 0, 2)), "SELECT 'sales.' || line AS target, ts, arg_min(val, flag) FILTER (val IS NOT NULL) AS val FROM S GROUP BY ALL")
add("mixed_intervals_sum", "events", lambda sl: across.aggregate_series(select.group(sl, windows.summarize(sl, "6h", "sum")), "sum"), f"SELECT 'sumSeries(*)' AS target, t AS ts, sum(v) AS val FROM (SELECT ceil(ts / {6 * HOUR}.0)::BIGINT * {6 * HOUR} AS t, target, avg(val) AS v FROM S GROUP BY ALL UNION ALL SELECT ts // {6 * HOUR} * {6 * HOUR}, 's' || target, sum(val) FROM S GROUP BY ALL) WHERE t <= (SELECT max(ts) FROM S) GROUP BY t")


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "events")
    sid = F.concat_ws(".", F.lit("events"), F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return t.select(sid.alias("sid"), F.unix_timestamp("ts").alias("ts"), F.col("value").cast("decimal(18,2)").cast("double").alias("val"))


def rollups(spark: SparkSession, d: str) -> DataFrame:
    """Hourly and daily rollups of every user's events."""
    points = _raw_events(spark, d)
    out = rollup.build(points.groupBy("sid", "ts").agg(F.max("val").alias("val")), [HOUR, DAY])  # one point a second
    return out.select("sid", "span", "ts", *[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in ("sum", "min", "max", "lst")], "cnt")


QUERIES["rollup_build"] = rollups
SQL["rollup_build"] = " UNION ALL ".join(
    f"SELECT sid, {s} AS span, CAST(ceil(t / {s}.0) AS BIGINT) * {s} AS ts, round(sum(v), {DIGITS}) + 0.0 AS sum, round(min(v), {DIGITS}) + 0.0 AS min, round(max(v), {DIGITS}) + 0.0 AS max, round(arg_max(v, t), {DIGITS}) + 0.0 AS lst, count(*) AS cnt "
    "FROM (SELECT 'events.' || event_type || '.u' || user_id AS sid, CAST(floor(epoch(ts)) AS BIGINT) AS t, max(CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE)) AS v FROM events GROUP BY ALL) GROUP BY ALL"
    for s in (HOUR, DAY)
)


def rollup_average(spark: SparkSession, d: str) -> DataFrame:
    points = _raw_events(spark, d).select("sid", "ts", "val")
    series = points.select("sid").distinct().select("sid", F.col("sid").alias("name"), F.create_map(F.lit("name"), F.col("sid")).alias("tags"), F.lit(HOUR).alias("interval"))
    return _rounded(rollup.read(series, rollup.build(points, [HOUR, DAY]), DAY, "average"))


QUERIES["rollup_average"] = rollup_average
SQL["rollup_average"] = f"SELECT 'events.' || event_type || '.u' || user_id AS target, CAST(ceil(floor(epoch(ts)) / {DAY}.0) AS BIGINT) * {DAY} AS ts, round(avg(CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE)), {DIGITS}) + 0.0 AS val FROM events GROUP BY ALL"


def quantized(spark: SparkSession, d: str) -> DataFrame:
    """The earliest price of each hour's slot for every kind of event, on a dense grid over all of them."""
    raw = _read(spark, d, "events").groupBy(F.concat(F.lit("events."), F.col("event_type")).alias("sid"), F.unix_timestamp("ts").alias("ts")).agg(F.max("value").alias("val"))
    ends = raw.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    series = raw.select("sid").distinct().select("sid", F.col("sid").alias("name"), F.create_map(F.lit("name"), F.col("sid")).alias("tags"), F.lit(HOUR).alias("interval"))
    return _rounded(grid.quantize(series, raw, ends.lo or 0, ends.hi or 0))


QUERIES["quantize"] = quantized
SQL["quantize"] = f"""
WITH raw AS (SELECT 'events.' || event_type AS target, CAST(floor(epoch(ts)) AS BIGINT) AS t, max(value) AS v FROM events GROUP BY ALL),
e AS (SELECT min(t) AS lo, max(t) AS hi FROM raw),
q AS (SELECT target, CAST(ceil(t / {HOUR}.0) AS BIGINT) * {HOUR} AS ts, arg_min(v, t) AS val FROM raw, e WHERE t > lo - {HOUR} AND t < hi GROUP BY ALL),
g AS (SELECT target, unnest(range(CAST(ceil(lo / {HOUR}.0) AS BIGINT) * {HOUR}, hi, {HOUR})) AS ts FROM (SELECT DISTINCT target FROM raw), e)
SELECT g.target, g.ts, round(q.val, {DIGITS}) + 0.0 AS val FROM g LEFT JOIN q USING (target, ts)"""

# ---- index ------------------------------------------------------------------------------------


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """A series for each customer: crm.<region>.<nation>.<segment>.c<key>."""
    c, n, r = (_read(spark, d, x) for x in ("customer", "nation", "region"))
    t = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    slug = lambda x: F.replace(F.col(x), F.lit(" "), F.lit("_"))
    name = F.concat_ws(".", F.lit("crm"), slug("r_name"), slug("n_name"), slug("c_mktsegment"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    tags = F.map_filter(F.create_map(F.lit("name"), F.lit("crm"), F.lit("region"), slug("r_name"), F.lit("nation"), slug("n_name"), F.lit("segment"), slug("c_mktsegment"), F.lit("debt"), F.when(F.col("c_acctbal") < 0, F.lit("yes"))), lambda k, v: v.isNotNull())
    return t.select(name.alias("sid"), F.when(F.col("c_custkey") % 10 == 0, 2).otherwise(1).alias("org"), name.alias("name"), F.lit(60).alias("interval"), tags.alias("tags"), (F.lit(1_700_000_000) + F.col("c_custkey") * 60).alias("last_update"))


_DEFS = """
WITH defs AS (
  SELECT 'crm.' || replace(r_name, ' ', '_') || '.' || replace(n_name, ' ', '_') || '.' || replace(c_mktsegment, ' ', '_') || '.c' || c_custkey AS name,
         CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS org, replace(r_name, ' ', '_') AS region, replace(n_name, ' ', '_') AS nation, replace(c_mktsegment, ' ', '_') AS segment,
         CASE WHEN c_acctbal < 0 THEN 'yes' END AS debt, 1700000000 + c_custkey * 60 AS last_update
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def add_index(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(definitions(spark, d))
    SQL[name] = _DEFS + sql


add_index("index_find_leaf", lambda x: index.find(x, "crm.A*.*.{BUILDING,MACHINERY}.c1?"), "SELECT DISTINCT name AS path, true AS leaf FROM defs WHERE regexp_matches(name, '^crm\\.A[^.]*\\.[^.]*\\.(BUILDING|MACHINERY)\\.c1[^.]?$')")
add_index("index_find_branch", lambda x: index.find(x, "crm.*.N*_1[0-4]"), "SELECT DISTINCT 'crm.' || region || '.' || nation AS path, false AS leaf FROM defs WHERE regexp_matches(nation, '^N.*_1[0-4]$')")
add_index("index_find_since", lambda x: index.find(x, "crm.*", since=1_700_004_500), "SELECT DISTINCT 'crm.' || region AS path, false AS leaf FROM defs WHERE last_update >= 1700004500")
add_index("index_expand", lambda x: index.expand(x, "crm.ASIA.*", "crm.E*.*.*"), "SELECT DISTINCT 'crm.ASIA.*' AS pattern, 'crm.ASIA.' || nation AS path FROM defs WHERE region = 'ASIA' UNION SELECT 'crm.E*.*.*', 'crm.' || region || '.' || nation || '.' || segment FROM defs WHERE region LIKE 'E%'")
add_index("index_names", index.names, "SELECT DISTINCT name FROM defs")
for _name, _expr, _where in (
    ("eq", ("segment=BUILDING",), "segment = 'BUILDING'"),
    ("ne", ("name=crm", "region!=ASIA"), "region <> 'ASIA'"),
    ("re", ("nation=~NATION_1.*",), "regexp_matches(nation, '^(?:NATION_1.*)')"),
    ("nre", ("name=crm", "debt!=~y.*"), "debt IS NULL"),
    ("prefix", ("segment^=MA",), "segment LIKE 'MA%'"),
    ("has", ("debt!=",), "debt IS NOT NULL"),
    ("has_not", ("name=crm", "debt="), "debt IS NULL"),
    ("tag_re", ("__tag=~de.*", "region=EUROPE"), "debt IS NOT NULL AND region = 'EUROPE'"),
    ("tag_prefix", ("__tag^=deb",), "debt IS NOT NULL"),
    ("empty_re", ("name=crm", "debt=~(yes)?"), "true"),
):
    add_index(f"find_by_tag_{_name}", lambda x, e=_expr: index.find_by_tag(x, *e).select("name"), f"SELECT name FROM defs WHERE {_where}")
add_index("index_public", lambda x: index.visible(x, 1, 2).select("name", "org"), "SELECT name, org FROM defs WHERE org IN (1, 2)")
add_index("index_meta_tags", lambda x: index.find_by_tag(index.with_meta_tags(x, [(["region=~A.*"], {"zone": "a", "region": "hidden"}), (["debt=yes"], {"zone": "debt"})]), "zone!=").select("name", F.col("tags")["zone"].alias("zone"), F.col("tags")["region"].alias("region")), "SELECT name, CASE WHEN region LIKE 'A%' THEN 'a' ELSE 'debt' END AS zone, region FROM defs WHERE region LIKE 'A%' OR debt = 'yes'")
add_index("tag_terms", index.tag_terms, "SELECT 'name' AS tag, 'crm' AS value, count(*) AS n FROM defs UNION ALL SELECT 'region', region, count(*) FROM defs GROUP BY region UNION ALL SELECT 'nation', nation, count(*) FROM defs GROUP BY nation UNION ALL SELECT 'segment', segment, count(*) FROM defs GROUP BY segment UNION ALL SELECT 'debt', debt, count(*) FROM defs WHERE debt IS NOT NULL GROUP BY debt")
add_index("tag_names", lambda x: index.tag_names(x, "[nr]"), "SELECT unnest(['name', 'nation', 'region']) AS tag")
add_index("tag_values", lambda x: index.tag_values(x, "nation", "NATION_[12]"), "SELECT nation AS value, count(*) AS n FROM defs WHERE regexp_matches(nation, '^NATION_[12]') GROUP BY nation")
add_index("autocomplete_tags", lambda x: index.complete_tags(x, "n", "region=ASIA"), "SELECT unnest(['name', 'nation']) AS tag")
add_index("autocomplete_values", lambda x: index.complete_values(x, "nation", "NATION_1", "segment=BUILDING", limit=3), "SELECT DISTINCT nation AS value FROM defs WHERE nation LIKE 'NATION\\_1%' ESCAPE '\\' AND segment = 'BUILDING' ORDER BY value LIMIT 3")
add_index("index_delete", lambda x: index.delete(x, "crm.A*").select("name"), "SELECT name FROM defs WHERE region NOT LIKE 'A%'")
add_index("index_delete_by_tag", lambda x: index.delete_by_tag(x, "debt=yes", older_than=1_700_030_000).select("name"), "SELECT name FROM defs WHERE NOT (coalesce(debt, '') = 'yes' AND last_update < 1700030000)")
add_index("index_prune", lambda x: index.prune(x, [("BUILDING", 40_000), ("^crm\\.A", 0), (".", 60_000)], 1_700_090_000).select("name"), "SELECT name FROM defs WHERE last_update >= CASE WHEN name LIKE '%BUILDING%' THEN 1700050000 WHEN name LIKE 'crm.A%' THEN 0 ELSE 1700030000 END")

# ---- sources and sinks ------------------------------------------------------------------------


def carbon(spark: SparkSession, d: str) -> DataFrame:
    """Events written as text lines, one in seven without a value, read back, validated and counted by reason."""
    t = _read(spark, d, "events")
    line = F.concat_ws(" ", F.concat(F.lit("events."), F.col("event_type"), F.lit(";user="), F.col("user_id").cast("string")), F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")), F.unix_timestamp("ts").cast("string"))
    return metrics.validated(metrics.carbon_lines(t.select(line.alias("value")))).groupBy("name", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES["source_carbon"] = carbon
SQL["source_carbon"] = "SELECT CASE WHEN event_id % 7 <> 0 THEN 'events.' || event_type END AS name, CASE WHEN event_id % 7 <> 0 THEN 'ok' ELSE 'invalid-name' END AS reason, count(*) AS n FROM events GROUP BY ALL"

QUERIES["sink_csv"] = lambda spark, d: metrics.to_csv(sales(spark, d)).select("target", "time", F.round(F.col("value").cast("double"), 2).alias("value"))
SQL["sink_csv"] = BASES["sales"][1] + " SELECT target, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS time, round(val, 2) AS value FROM S"


def json_points(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the JSON has: each point and a tag."""
    text = metrics.to_json(sales(spark, d)).select("target", F.from_json("json", "target string, tags map<string,string>, datapoints array<array<double>>").alias("j"))
    each = text.select("target", F.col("j.target").alias("named"), F.col("j.tags")["flag"].alias("flag"), F.explode("j.datapoints").alias("p"))
    return each.select("target", "named", "flag", F.get("p", F.lit(1)).cast("long").alias("ts"), F.round(F.get("p", F.lit(0)), 2).alias("val"))


QUERIES["sink_json"] = json_points
SQL["sink_json"] = BASES["sales"][1] + " SELECT target, target AS named, flag, ts, round(val, 2) AS val FROM S"


def json_messages(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON messages, most with one fault, read back, validated and counted by reason."""
    k = F.col("event_id") % 8
    message = F.to_json(F.struct(
        F.when(k != 1, 1).alias("org"), F.when(k == 2, 0).otherwise(60).alias("interval"), F.when(k != 3, F.concat(F.lit("events."), F.col("event_type"))).alias("name"), F.when(k == 4, "guess").otherwise("count").alias("mtype"),
        F.array(F.when(k == 5, "x").otherwise("a=b")).alias("tags"), F.when(k == 6, -1).otherwise(F.unix_timestamp("ts")).alias("time"), F.when(k != 7, F.col("value")).alias("value"), F.lit("n").alias("unit"),
    ))
    return metrics.validated(metrics.json_messages(_read(spark, d, "events").select(message.alias("value")))).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES["source_json"] = json_messages
SQL["source_json"] = "SELECT ['ok', 'invalid-org', 'invalid-interval', 'invalid-name', 'invalid-mtype', 'invalid-tag', 'invalid-time', 'invalid-value'][event_id % 8 + 1] AS reason, count(*) AS n FROM events GROUP BY ALL"
QUERIES["resample_finer"] = lambda spark, d: (lambda sl: _rounded(sl.with_points(metrics.resampled(sl.points.where("val IS NOT NULL"), DAY, 6 * HOUR))))(sales(spark, d))
SQL["resample_finer"] = BASES["sales"][1] + f" SELECT target, ts - x * {6 * HOUR} AS ts, round(val, {DIGITS}) + 0.0 AS val FROM S, (SELECT unnest([0, 1, 2, 3]) AS x) WHERE val IS NOT NULL"
QUERIES["combined_stores"] = lambda spark, d: (lambda sl: _rounded(sl.with_points(metrics.combined(sl.points.where("ts >= 852076800 AND val IS NOT NULL"), pointwise.scale(sl, 2).points))))(sales(spark, d))
SQL["combined_stores"] = BASES["sales"][1] + f", h AS (SELECT target, min(ts) AS f FROM S WHERE ts >= 852076800 AND val IS NOT NULL GROUP BY target) SELECT S.target, ts, round(val, {DIGITS}) + 0.0 AS val FROM S JOIN h USING (target) WHERE ts >= 852076800 AND val IS NOT NULL UNION ALL SELECT S.target, ts, round(val * 2, {DIGITS}) + 0.0 FROM S LEFT JOIN h USING (target) WHERE f IS NULL OR ts < f"

# ---- tags --------------------------------------------------------------------------------------


def add_tags(name: str, f: Callable[[SeriesList], SeriesList], target: str, tags: dict[str, str], source: str = "(SELECT DISTINCT target, status, priority FROM S)") -> None:
    """The tags of the result's series: target, tag, value. tags: SQL for each tag's value."""
    QUERIES[f"tags_{name}"] = lambda spark, d: f(orders(spark, d)).series.select("target", F.explode("tags").alias("tag", "value"))
    SQL[f"tags_{name}"] = BASES["orders"][1] + " UNION ALL ".join(f" SELECT {target} AS target, '{k}' AS tag, {v} AS value FROM {source}" for k, v in tags.items())


_OWN = {"name": "'orders'", "status": "status", "priority": "priority"}
for _fn, _args, _target, _more in (
    ("absolute", (), "'absolute(' || target || ')'", {"absolute": "'1'"}),
    ("log", (2,), "'log(' || target || ',2)'", {"log": "'2'"}),
    ("round", (1,), "'round(' || target || ',1)'", {"round": "'1'"}),
    ("movingMax", ("7d",), "'movingMax(' || target || ',\"7d\")'", {"movingMax": "'7d'"}),
    ("timeShift", ("1d",), "'timeShift(' || target || ', \"-1d\")'", {"timeShift": "'-1d'"}),
    ("summarize", ("7d", "max"), "'summarize(' || target || ', \"7d\", \"max\")'", {"summarize": "'7d'", "summarizeFunction": "'max'"}),
    ("removeAbovePercentile", (50,), "'removeAbovePercentile(' || target || ', 50)'", {"nPercentile": "'50'"}),
    ("scale", (2,), "'scale(' || target || ',2)'", {}),
    ("aliasByNode", (2,), "priority", {"name": "priority"}),
):
    add_tags(_fn, lambda sl, n=_fn, a=_args: apply(n, sl, *a), _target, _OWN | _more)
add_tags("alias", lambda sl: apply("alias", select.grep(sl, "URGENT"), "urgent"), "'urgent'", _OWN | {"name": "'urgent'"}, "(SELECT DISTINCT status, priority FROM S WHERE target LIKE '%URGENT%')")
add_tags("sumSeries", lambda sl: apply("sumSeries", sl), "'sumSeries(*)'", {"name": "'orders'", "aggregatedBy": "'sum'"}, "(SELECT 1)")
add_tags("sumSeries_of_one", lambda sl: apply("sumSeries", select.grep(sl, "F.*URGENT")), "'sumSeries(*)'", _OWN, "(SELECT DISTINCT status, priority FROM S WHERE target LIKE '%.F.%URGENT%')")
add_tags("groupByNode", lambda sl: apply("groupByNode", sl, 1, "max"), "status", {"name": "'orders'", "status": "status", "aggregatedBy": "'max'"}, "(SELECT DISTINCT status FROM S)")
add_tags("divideSeries", lambda sl: apply("divideSeries", sl, apply("max", sl)), "'divideSeries(' || target || ',maxSeries(*))'", {"name": "'divideSeries(' || target || ',maxSeries(*))'"})
add_tags("countSeries", lambda sl: apply("countSeries", sl), "'countSeries(*)'", {"name": "'countSeries(*)'"}, "(SELECT 1)")

# ---- requests ----------------------------------------------------------------------------------

#: Requests are for two years of orders, and for ten days of events.
YEARS, DAYS, NOW = (820454400, 883612800), ("00:00_20240105", "00:00_20240115"), 1_720_000_000


def order_store(spark: SparkSession, d: str) -> Store:
    """Daily orders as definitions and points."""
    sl = orders(spark, d)
    return Store(sl.series.select("sid", "name", "tags", "interval"), sl.points.where("val IS NOT NULL"), intervals=[DAY])


def event_store(spark: SparkSession, d: str) -> Store:
    """Hourly events, kept for twenty days, with daily rollups for two years."""
    sl = events(spark, d)
    points = sl.points.where("val IS NOT NULL")
    return Store(sl.series.select("sid", "name", "tags", "interval"), points, rollup.build(points, [DAY]), [StorageRule.of("events", "^events", "1h:20d,1d:2y")], [HOUR])


def add_request(name: str, targets: str | list[str], sql: str, more: str = "", **options) -> None:
    """sql: a SELECT of target, ts, val from S, at all times; those asked for are cut out of it."""
    QUERIES[f"render_{name}"] = lambda spark, d: _rounded(render(order_store(spark, d), targets, *YEARS, now=NOW, **options))
    SQL[f"render_{name}"] = f"{BASES['orders'][1]}{', ' + more if more else ''}, r AS ({sql}) SELECT target, ts, round(CAST(val AS DOUBLE), {DIGITS}) + 0.0 AS val FROM r WHERE ts > {YEARS[0]} AND ts <= {YEARS[1]}"


add_request("pattern", "orders.F.*", "SELECT target, ts, val FROM S WHERE status = 'F'")
add_request("path_with_tags", "orders.*.{1,2}-*;status=O", "SELECT target, ts, val FROM S WHERE status = 'O' AND priority[1] IN ('1', '2')")
add_request(
    "nested_and_piped", 'sumSeries(movingAverage(orders.{F,O}.*, "7d"))|scale(2)',
    "SELECT 'scale(sumSeries(movingAverage(orders.{F,O}.*,\"7d\")),2)' AS target, ts, 2 * sum(m) AS val FROM (SELECT ts, avg(val) OVER (PARTITION BY target ORDER BY ts RANGE BETWEEN " + str(7 * DAY) + " PRECEDING AND 1 PRECEDING) AS m FROM S WHERE status IN ('F', 'O')) GROUP BY ts",
)
add_request("series_by_tag", "seriesByTag('name=orders', 'status!=P', 'priority=~[12]') | maxSeries()", "SELECT 'maxSeries(seriesByTag(''name=orders'',''status!=P'',''priority=~[12]''))' AS target, ts, max(val) AS val FROM S WHERE status <> 'P' AND priority[1] IN ('1', '2') GROUP BY ts")
add_request(
    "time_shift", 'divideSeries(sumSeries(orders.*.*), timeShift(sumSeries(orders.*.*), "365d"))',
    f"SELECT 'divideSeries(sumSeries(orders.*.*),timeShift(sumSeries(orders.*.*), \"-365d\"))' AS target, a.ts, a.val / nullif(b.val, 0) AS val FROM t a LEFT JOIN t b ON b.ts = a.ts - {365 * DAY}", "t AS (SELECT ts, sum(val) AS val FROM S GROUP BY ts)",
)
add_request("named_arguments", 'aggregate(orders.*.*, func="max", xFilesFactor=0.3)', "SELECT 'maxSeries(orders.*.*)' AS target, ts, CASE WHEN count(val) >= 0.3 * count(*) AND count(val) > 0 THEN max(val) END AS val FROM S GROUP BY ts")
add_request("targets", ["orders.F.1*", "aliasByNode(orders.O.*, 1, 2)"], "SELECT target, ts, val FROM S WHERE status = 'F' AND priority[1] = '1' UNION ALL SELECT status || '.' || priority, ts, val FROM S WHERE status = 'O'")
add_request("percent", "asPercent(orders.F.*, sumSeries(orders.*.*))", "SELECT 'asPercent(' || target || ',sumSeries(orders.*.*))' AS target, ts, 100 * val / nullif(w, 0) AS val FROM S JOIN (SELECT ts, sum(val) AS w FROM S GROUP BY ts) USING (ts) WHERE status = 'F'")
add_request("top_groups", 'highestMax(groupByNode(orders.*.*, 2, "sum"), 2)', f"SELECT g.target, ts, val FROM g SEMI JOIN (SELECT target FROM g WHERE ts > {YEARS[0]} AND ts <= {YEARS[1]} GROUP BY target ORDER BY max(val) DESC NULLS LAST, target LIMIT 2) USING (target)", "g AS (SELECT priority AS target, ts, sum(val) AS val FROM S GROUP BY ALL)")
add_request(
    "line", 'linearRegression(orders.O.*, "00:00_19960101", "00:00_19970101")',
    "SELECT 'linearRegression(' || S.target || ', 820454400, 852076800)' AS target, ts, base + slope * ts / 86400 AS val FROM S JOIN l USING (target)",
    "l AS (SELECT target, regr_slope(val, ts / 86400) AS slope, regr_intercept(val, ts / 86400) AS base FROM S WHERE status = 'O' AND ts >= 820454400 AND ts < 852076800 GROUP BY target)",
)
QUERIES["render_line"] = lambda spark, d: _rounded(render(order_store(spark, d), 'linearRegression(orders.O.*, "00:00_19960101", "00:00_19970101")', *YEARS, now=NOW), 3)
SQL["render_line"] = SQL["render_line"].replace(f"AS DOUBLE), {DIGITS})", "AS DOUBLE), 3)")
QUERIES["render_max_points"] = lambda spark, d: _rounded(render(order_store(spark, d), 'consolidateBy(orders.O.*, "max")', *YEARS, now=NOW, max_points=100))
SQL["render_max_points"] = BASES["orders"][1] + f""", c AS (SELECT target, val, ts, count(*) OVER w AS n, min(ts) OVER w AS f, row_number() OVER (PARTITION BY target ORDER BY ts) - 1 AS i FROM S WHERE status = 'O' AND ts > {YEARS[0]} AND ts <= {YEARS[1]} WINDOW w AS (PARTITION BY target)),
kk AS (SELECT *, CAST(greatest(1, ceil(n / 100.0)) AS BIGINT) AS k FROM c),
z AS (SELECT *, CASE WHEN k > 1 AND n > 2 * k THEN ((-(f - {DAY}) % (k * {DAY})) + k * {DAY}) % (k * {DAY}) // {DAY} ELSE 0 END AS s FROM kk),
u AS (SELECT target, val, ts, k, (i - s) // k AS u FROM z WHERE i >= s)
SELECT 'consolidateBy(' || target || ',"max")' AS target, min(u.ts) + (any_value(k) - 1) * {DAY} AS ts, round(max(val), {DIGITS}) + 0.0 AS val FROM u GROUP BY target, u"""
for _how, _agg in (("sum", "sum(val)"), ("average", "avg(val)"), ("max", "max(val)")):
    _target = f'consolidateBy(events.*, "{_how}")'
    QUERIES[f"render_rollup_{_how}"] = lambda spark, d, t=_target: _rounded(render(event_store(spark, d), t, *DAYS, now=NOW))
    SQL[f"render_rollup_{_how}"] = BASES["events"][1] + f"""
SELECT 'consolidateBy(' || target || ',"{_how}")' AS target, t AS ts, round({_agg}, {DIGITS}) + 0.0 AS val FROM (SELECT target, CAST(ceil(ts / {DAY}.0) AS BIGINT) * {DAY} AS t, val FROM S)
WHERE t > epoch(TIMESTAMP '2024-01-05') AND t <= epoch(TIMESTAMP '2024-01-15') GROUP BY target, t"""
