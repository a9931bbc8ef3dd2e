"""Targets in text, times, and what is fetched for them."""

import pytest

from gridtide.functions.registry import UnknownFunction
from gridtide.operators import rollup
from gridtide.plans.retention import StorageRule
from gridtide.requests import BadRequest, Call, Pattern, Store, explain, parse, render, time_of
from gridtide.series import SeriesList


def test_targets():
    assert parse("a.{b,c{d,e}}.[x-z]*") == Pattern("a.{b,c{d,e}}.[x-z]*")
    assert parse(' scale( a.b , 2.5 ) | alias("x y")') == Call("alias", (Call("scale", (Pattern("a.b"), 2.5)), "x y"))
    assert parse("aggregate(a, 'sum', xFilesFactor=0.5)") == Call("aggregate", (Pattern("a"), "sum"), {"xFilesFactor": 0.5})
    assert parse("summarize(a, '1h', \"sum\", true)") == Call("summarize", (Pattern("a"), "1h", "sum", True))
    assert parse("asPercent(a, None, 1)") == Call("asPercent", (Pattern("a"), None, 1))
    assert parse("offset(1.x, -3)") == Call("offset", (Pattern("1.x"), -3))
    assert parse("sum(a)|scale(1e3)|alias('b')").args[0].args[1] == 1000.0
    assert parse("seriesByTag('a=b', 'c=~d(e|f)')").tags == ("a=b", "c=~d(e|f)")
    assert explain(["a", "sum(b)"]) == [Pattern("a"), Call("sum", (Pattern("b"),))]
    for bad in ("", "sum(a", "sum(a))", "a|b", "sum(a,)b", "alias(a, 'b)", "scale(a, 2 3)", "seriesByTag(a)", "aggregate(a, func='sum', 2)", "'x'"):
        with pytest.raises(BadRequest):
            parse(bad)
    with pytest.raises(UnknownFunction):
        parse("noSuch(a)")


def test_times():
    now = 1_700_000_000
    assert [time_of(t, now) for t in ("now", "-1h", "now-2d", "now+1min", 5, "1699999999")] == [now, now - 3600, now - 172800, now + 60, 5, 1699999999]
    assert time_of("20240101", now) == 1704067200
    assert time_of("10:30_20240701", now, "Europe/Berlin") == 1719822600
    assert time_of("midnight", now) == 1699920000
    assert time_of("yesterday", now) == 1699833600
    with pytest.raises(BadRequest):
        time_of("soon", now)


@pytest.fixture(scope="module")
def store(spark):
    names = ["a.x", "a.y", "b.x"]
    defs = spark.createDataFrame([(n, n, {"name": n, "k": n[0]}, 10) for n in names], "sid string, name string, tags map<string,string>, interval int")
    points = spark.createDataFrame([(n, t, float(t + i)) for i, n in enumerate(names) for t in range(10, 1010, 10)], "sid string, ts long, val double")
    return Store(defs, points, rollup.build(points, [50, 100]), [StorageRule.of("b", "^b", "10s:1d"), StorageRule.of("all", ".", "10s:5min,50s:1d")], [10])


def rows(sl):
    return sorted((r.target, r.ts, r.val) for r in sl.rows().collect())


def test_ranges(spark, store):
    assert rows(render(store, "a.x", 90, 110, now=200)) == [("a.x", 100, 100.0), ("a.x", 110, 110.0)]
    assert rows(render(store, 'movingSum(a.x, "30s")', 100, 120, now=200)) == [('movingSum(a.x,"30s")', 110, 270.0), ('movingSum(a.x,"30s")', 120, 300.0)]
    assert rows(render(store, 'timeShift(a.x, "50s")', 100, 120, now=200)) == [('timeShift(a.x, "-50s")', 110, 60.0), ('timeShift(a.x, "-50s")', 120, 70.0)]
    assert rows(render(store, "a.*;k=a|sumSeries()|scale(2)", 100, 110, now=200)) == [("scale(sumSeries(a.*;k=a),2)", 110, 442.0)]
    assert rows(render(store, "seriesByTag('k=b')", 100, 110, now=200)) == [("b.x", 110, 112.0)]
    assert rows(render(store, ["constantLine(3)", "b.x"], 100, 110, now=200))[-1] == ("b.x", 110, 112.0)
    assert rows(render(store, "no.*", 100, 110, now=200)) == []


def test_archives(spark, store):
    """Raw points are gone for a.x and a.y, whose rule has rollups; b.x has nothing else."""
    got = rows(render(store, 'consolidateBy(*.x, "sum")', 100, 200, now=5000))
    assert [r for r in got if "a.x" in r[0]] == [('consolidateBy(a.x,"sum")', 150, 650.0), ('consolidateBy(a.x,"sum")', 200, 900.0)]
    assert len([r for r in got if "b.x" in r[0]]) == 10
    assert rows(render(store, "a.x", 100, 200, now=5000)) == [("a.x", 150, 130.0), ("a.x", 200, 180.0)]
    both = rows(render(store, "sumSeries(*.x)", 100, 200, now=5000))  # at 50 seconds
    assert both == [("sumSeries(*.x)", 150, 130.0 + 132.0), ("sumSeries(*.x)", 200, 180.0 + 182.0)]


def test_limits(spark, store):
    with pytest.raises(BadRequest, match="series"):
        render(store, "a.*", 100, 200, now=200, max_series=1)
    with pytest.raises(BadRequest, match="slots"):
        render(store, "a.*", 100, 200, now=200, max_slots=5)
    with pytest.raises(BadRequest, match="empty"):
        render(store, "a.*", 200, 100, now=200)
    with pytest.raises(BadRequest, match="scale"):
        render(store, "scale(a.*)", 100, 200, now=200)
    assert len(rows(render(store, "a.x", 100, 200, now=200, max_points=5))) == 5
    assert isinstance(render(store, "a.x", 0, 200, now=200), SeriesList)
