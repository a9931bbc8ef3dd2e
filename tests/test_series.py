"""Small series with known results: missing values, ties, empty lists, bounds."""

import math
import random
import re
import statistics

import pytest

from gridtide.functions import REGISTRY, across, apply, combine, naming, pointwise, select, windows
from gridtide.operators import grid, index
from gridtide.operators.index import TagExpression
from gridtide.plans.retention import Retention, StorageRule, choose, closest_rollup, rule_for
from gridtide.series import SeriesList, seconds
from gridtide.sources import metrics

N = None
INF = float("inf")


def make(spark, interval=10, **values):
    series = [(k, k, {"name": k}, interval) for k in values]
    points = [(k, interval * (i + 1), v) for k, vs in values.items() for i, v in enumerate(vs)]
    return SeriesList.of(
        spark.createDataFrame(series, "sid string, name string, tags map<string,string>, interval int"),
        spark.createDataFrame(points, "sid string, ts long, val double"),
    )


def values(sl):
    out = {}
    for r in sorted(sl.rows().collect(), key=lambda r: (r.target, r.ts)):
        out.setdefault(r.target, []).append(r.val)
    return out


def one(sl):
    (v,) = values(sl).values()
    return v


def made(seed, n, gaps=0.25, low=-50, high=50):
    """n made-up values, some of them missing."""
    r = random.Random(seed)
    return [N if r.random() < gaps else round(r.uniform(low, high), 2) for _ in range(n)]


def close(got, want):
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


@pytest.fixture(scope="module")
def three(spark):
    return make(spark, **{k: made(i, 40) for i, k in enumerate("abc")})


def test_all_names():
    assert len(REGISTRY) == 91


def test_nan_is_missing(spark):
    assert one(make(spark, x=[float("nan"), 1.0])) == [N, 1.0]
    assert one(make(spark, x=[INF, 1.0])) == [INF, 1.0]
    assert one(pointwise.offset(make(spark, x=[INF]), -INF)) == [N]


BY_HAND = {
    "sum": sum, "average": statistics.fmean, "min": min, "max": max, "median": statistics.median, "stddev": statistics.pstdev, "range": lambda v: max(v) - min(v), "count": len,
    "last": lambda v: v[-1], "diff": lambda v: v[0] - sum(v[1:]), "multiply": math.prod,
}


def by_hand(how, column):
    """The aggregate of the values at one time, or of a window."""
    seen = [v for v in column if v is not None]
    if how == "avg_zero":
        return sum(seen) / len(column)
    if not seen or (how == "multiply" and len(seen) < len(column)):
        return N
    return float(BY_HAND[how](seen))


@pytest.mark.parametrize("how", [*BY_HAND, "avg_zero"])
def test_across(three, how):
    columns = list(zip(*[made(i, 40) for i in range(3)], strict=True))
    close(one(across.aggregate_series(three, how)), [by_hand(how, c) for c in columns])


def test_share_is_of_all_series(spark):
    """Of a list that isn't dense too: absent rows count as missing."""
    sparse = make(spark, a=[1.0, 2.0, 3.0], b=[10.0], c=[N, 5.0, N])
    assert one(across.aggregate_series(sparse, "sum", 0.5)) == [11, 7, N]
    assert one(across.aggregate_series(sparse, "multiply")) == [N, N, N]
    assert one(across.aggregate_series(sparse, "avg_zero")) == pytest.approx([11 / 3, 7 / 3, 1])


def tags(sl):
    return {r.target: r.tags for r in sl.series.collect()}


def test_one_series_passes_through(spark):
    x = make(spark, x=[3.0, N, 5.0])
    for how, name in (("stddevSeries", "stddevSeries(*)"), ("rangeOfSeries", "rangeOfSeries(*)"), ("avg", "averageSeries(*)")):
        assert values(apply(how, x)) == {name: [3, N, 5]}
        assert tags(apply(how, x)) == {name: {"name": "x"}}
    assert one(across.aggregate_series(x, "count", 0.5)) == [3, N, 5]
    assert values(across.with_wildcards(make(spark, **{"a.b": [3.0]}), "range", 1)) == {"a": [3]}
    assert values(across.group_by_node(make(spark, **{"a.b": [3.0]}), 0, "range")) == {"a": [0]}  # groups don't


def test_several_lists(spark):
    x, y = make(spark, a=[1.0], b=[2.0]), pointwise.scale(make(spark, c=[5.0]), 2)
    assert values(apply("sum", x, y)) == {"sumSeries(*,scale(*,2))": [13]}
    assert values(apply("sum", select.group(x, y))) == {"sumSeries(*)": [13]}
    assert values(apply("sum", x, pattern="foo.*")) == {"sumSeries(foo.*)": [3]}
    assert values(apply("countSeries", x, y)) == {"countSeries(*,scale(*,2))": [3]}
    assert set(values(apply("perSecond", x, y))) == {"perSecond(a)", "perSecond(b)", "perSecond(scale(c,2))"}
    assert values(across.aggregate_series(x, y, "sum", 1.0)) == {"sumSeries(*,scale(*,2))": [13]}


def test_names_and_tags(spark):
    x = make(spark, x=[1.0, 2.0])
    assert tags(naming.consolidate_by(x, "max")) == {'consolidateBy(x,"max")': {"name": "x"}}
    assert tags(windows.time_shift(x, "+1h")) == {'timeShift(x, "+1h")': {"name": "x", "timeShift": "+1h"}}
    assert tags(windows.linear_regression(x, 0, 100)) == {"linearRegression(x, 0, 100)": {"name": "x", "linearRegressions": "0, 100"}}
    assert tags(pointwise.transform_null(x)) == {"transformNull(x)": {"name": "x"}}
    assert tags(pointwise.transform_null(x, 0)) == {"transformNull(x,0)": {"name": "x"}}
    assert tags(naming.alias(pointwise.absolute(x), "y")) == {"y": {"name": "y", "absolute": "1"}}
    assert tags(combine.as_percent(x, 10)) == {"asPercent(x,10)": {"name": "asPercent(x,10)"}}
    both = make(spark, a=[1.0], b=[2.0])
    assert tags(apply("sum", both)) == {"sumSeries(*)": {"aggregatedBy": "sum", "name": "sumSeries(*)"}}


def test_functions_run_no_jobs(spark, three):
    """A list whose intervals are known is one plan: nothing is computed before the result is asked for."""
    known = SeriesList.of(three.series.drop("consolidator"), three.points, [10])
    group = "no jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        total = apply("sumSeries", known)
        out = [apply("divideSeries", known, total), combine.as_percent(known), combine.as_percent(known, total), combine.divide_series_lists(known, known), select.fallback_series(known, total), apply("countSeries", known), apply("groupByTags", known, "sum", "name"), select.sort_by(known, "max"), apply("movingAverage", known, "20s")]
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert all(o.points.count() for o in out)


def test_sources_are_read_once(spark):
    """The table at the fetch, and its points once for a sum and twice for shares of a sum."""
    from gridtide.queries import orders

    sl = orders(spark, "/root/testdata/sf0.001")
    total = apply("sumSeries", sl)
    plan = lambda x: x.rows()._jdf.queryExecution().executedPlan().toString()
    assert plan(total).count("/orders.parquet") == 0
    assert len(re.findall(r"FileScan parquet.*/fetched-", plan(total))) == 1
    assert len(re.findall(r"FileScan parquet.*/fetched-", plan(apply("divideSeries", sl, total)))) == 2


def wrapped(a, b, most):
    """Growth from a to b of a counter that may wrap at most."""
    if a is None or b is None:
        return N
    return b - a if b >= a else N if most is None else most + 1 + b - a


def test_windows(spark):
    raw = [N if v is None else abs(v) for v in made(11, 60)]
    c = make(spark, c=raw)
    before = list(zip([N, *raw], raw, strict=False))
    close(one(windows.derivative(c)), [N if N in p else p[1] - p[0] for p in before])
    close(one(windows.non_negative_derivative(c)), [wrapped(*p, N) for p in before])
    limit = lambda v, m: N if v is None or v > m else v
    close(one(windows.non_negative_derivative(c, 40)), [wrapped(limit(a, 40), limit(b, 40), 40) for a, b in before])
    close(one(windows.per_second(c, 63)), [N if (w := wrapped(*p, 63)) is None else w / 10 for p in before])
    close(one(windows.per_second(c)), [N if (w := wrapped(*p, N)) is None else w / 10 for p in before])
    close(one(windows.integral(c)), [N if v is None else sum(x for x in raw[: i + 1] if x is not None) for i, v in enumerate(raw)])
    for how in ("average", "max", "median", "sum", "stddev"):
        close(one(windows.moving_window(c, 30, how)), [by_hand(how, raw[max(0, i - 3) : i]) if i else N for i in range(len(raw))])
    full = lambda w: w and N not in w
    close(one(windows.moving_window(c, 20, "sum", 1.0)), [sum(w) if full(w := raw[max(0, i - 2) : i]) else N for i in range(len(raw))])


def test_keep_last_value(spark):
    x = make(spark, x=[N, 1.0, N, N, 2.0, N])
    assert one(windows.keep_last_value(x)) == [N, 1, 1, 1, 2, 2]
    assert one(windows.keep_last_value(x, 1)) == [N, 1, N, N, 2, 2]


def test_pointwise_bounds(spark):
    x = make(spark, x=[-2.5, 0.0, 1.005, N, INF])
    assert one(pointwise.round_(x)) == [-3, 0, 1, N, INF]
    assert one(pointwise.invert(x))[:2] == [-0.4, N]
    assert one(pointwise.log(x))[:2] == [N, N]
    with pytest.raises(ValueError, match="base"):
        pointwise.log(x, 1)


def test_empty_list(spark):
    e = make(spark, x=[1.0]).only(make(spark, x=[1.0]).series.where("false"))
    assert values(across.aggregate_series(e, "sum")) == {}
    assert values(select.highest(e, 3)) == {}
    assert values(windows.integral(e)) == {}
    assert values(grid.consolidate(e, 10)) == {}


def test_selection(spark):
    x = make(spark, a=[1.0, 9.0], b=[3.0, N], c=[N, N])
    assert set(values(select.highest(x, 2, "max"))) == {"a", "b"}
    assert set(values(select.lowest(x, 1, "max"))) == {"c"}
    assert set(values(apply("averageBelow", x, 3))) == {"b", "c"}
    assert set(values(apply("averageAbove", x, 3))) == {"a"}
    assert set(values(select.remove_empty_series(x))) == {"a", "b"}
    assert set(values(select.remove_zero_series(make(spark, z=[0.0, 0.0], n=[0.0, N])))) == {"n"}
    names = lambda sl: [r.target for r in sl.series.orderBy("ord").collect()]
    assert names(select.sort_by_name(make(spark, s10=[1.0], s9=[1.0]), natural=True)) == ["s9", "s10"]
    with pytest.raises(ValueError, match="look-around"):
        select.grep(x, "(?=a)")


def test_percentile_and_line(spark):
    x = make(spark, x=[float(i) for i in range(1, 11)], y=[N] * 10)
    assert values(windows.remove_above_percentile(x, 50)) == {"removeAbovePercentile(x, 50)": [1, 2, 3, 4, 5, 6, N, N, N, N]}
    assert values(windows.linear_regression(x))["linearRegression(x)"] == pytest.approx(range(1, 11))
    assert one(windows.min_max(make(spark, x=[3.0, 3.0, N]))) == [0, 0, N]


def test_combination(spark):
    x, y = make(spark, a=[1.0, 2.0], b=[4.0, 0.0]), make(spark, t=[2.0, 0.0])
    assert values(combine.divide_series(x, y)) == {"divideSeries(a,t)": [0.5, N], "divideSeries(b,t)": [2, N]}
    with pytest.raises(Exception, match="exactly one"):
        combine.divide_series(x, x).rows().collect()
    with pytest.raises(Exception, match="different lengths"):
        combine.divide_series_lists(x, y).rows().collect()
    assert values(combine.as_percent(x))["asPercent(a,sumSeries(*))"] == [20, 100]
    assert values(combine.as_percent(make(spark, a=[1.0]), make(spark, b=[2.0]), 0)) == {"asPercent(a,MISSING)": [N], "asPercent(MISSING,sumSeries(b))": [N]}


def test_names(spark):
    x = make(spark, **{"a.b.c": [1.0]})
    assert list(values(naming.alias_by_node(x, -1, 0, 7))) == ["c.a"]
    assert list(values(naming.alias_sub(x, r"(\w)\.(\w)", r"\2\1"))) == ["ba.c"]
    assert list(values(naming.substr(pointwise.absolute(x), -2))) == ["b.c"]


def test_grids(spark):
    x = make(spark, interval=10, x=[float(i) for i in range(1, 12)])
    out = grid.consolidate(naming.consolidate_by(x, "sum"), 4)
    assert sorted((r.ts, r.val) for r in out.points.collect()) == [(30, 6.0), (60, 15.0), (90, 24.0), (120, 21.0)]
    late = make(spark, interval=10, x=[float(i) for i in range(1, 12)])
    late = late.with_points(late.points.withColumn("ts", late.points.ts + 10))
    out = grid.consolidate(naming.consolidate_by(late, "sum"), 4)  # 20..120: 20 and 30 aren't a whole run
    assert sorted((r.ts, r.val) for r in out.points.collect()) == [(60, 12.0), (90, 21.0), (120, 30.0)]
    raw = spark.createDataFrame([("s", 11, 1.0), ("s", 12, 2.0), ("s", 20, 3.0), ("s", 41, 4.0), ("s", 50, 5.0)], "sid string, ts long, val double")
    s = spark.createDataFrame([("s", "s", {"name": "s"}, 10)], "sid string, name string, tags map<string,string>, interval int")
    assert one(grid.quantize(s, raw, 15, 50)) == [1, N, N]
    mixed = select.group(make(spark, interval=10, a=[1.0, 3.0, 5.0]), make(spark, interval=20, b=[10.0]))
    assert one(across.aggregate_series(mixed, "sum")) == [12]


def test_durations():
    assert [seconds(x) for x in ("5min", "1h30min", "90", 7, "2d")] == [300, 5400, 90, 7, 172800]
    for bad in ("", "5 parsecs", "x5"):
        with pytest.raises(ValueError, match="duration"):
            seconds(bad)


def test_retention():
    rules = [StorageRule.of("fast", r"^fast\.", "1s:8d,1m:35d"), StorageRule.of("default", ".*", "10s:1d,1min:30d,1h:2y")]
    assert rule_for("fast.x", rules).name == "fast"
    kept = rule_for("x", rules).retentions
    now = 10**8
    assert choose(kept, now - 3600, now, now).interval == 10
    assert choose(kept, now - 2 * 86400, now, now).interval == 60
    assert choose(kept, now - 5 * 31536000, now, now).interval == 3600
    assert choose(kept, now - 6 * 3600, now, now, max_points=300).interval == 60
    assert Retention.of("1h:2y:6h:2").ttl == 2 * 31536000
    with pytest.raises(ValueError, match="multiples"):
        StorageRule.of("bad", "x", "10s:1d,15s:2d")
    assert closest_rollup("sum", ["average", "max"]) == "average"
    assert [closest_rollup(w, ["average", "last"]) for w in ("sum", "min", "max", "last")] == ["last"] * 4
    assert closest_rollup("sum", ["min", "max"]) == "max"


def test_tag_expressions(spark):
    assert TagExpression.of("a!=~b") == TagExpression("a", "!=~", "b")
    assert TagExpression.of("a=~b=c") == TagExpression("a", "=~", "b=c")
    with pytest.raises(ValueError, match="tag expression"):
        TagExpression.of("nothing")
    defs = spark.createDataFrame([("s", {"name": "n"})], "sid string, tags map<string,string>")
    with pytest.raises(ValueError, match="must ask"):
        index.find_by_tag(defs, "a!=b")


def test_sources(spark):
    lines = spark.createDataFrame([("a.b;k=v 1.5 1700000000",), ("a.b 2",), ("a.b x 5",), ("a.b;bad 1 5",), ("a 1 0",)], "value string")
    rows = metrics.validated(metrics.carbon_lines(lines)).collect()
    assert [r.reason for r in rows] == [None, "invalid-name", "invalid-value", "invalid-tag", "invalid-time"]
    good = metrics.validated(metrics.carbon_lines(lines)).where("reason IS NULL")
    (d,) = metrics.definitions(good).collect()
    assert d.tags == {"k": "v", "name": "a.b"}
    assert metrics.points_of(good).first().sid == d.sid
    made = metrics.synthetic(spark, 3, 4)
    assert metrics.validated(made).where("reason IS NOT NULL").count() == 0
    assert metrics.definitions(made).count() == 3
