"""Requests: targets in text, over a time range, answered from a store of definitions and points.

A target such as `sumSeries(movingAverage(foo.{a,b}.*, "1h"))|scale(2)` is read into calls of the registered functions on lists of
series, which the index and the archives give; from there on it is one lazy plan. What functions need of the range that is
fetched (a moving window looks back, a shift reads elsewhere) is known here by name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.aggregates import canonical
from gridtide.functions.combine import constant_line
from gridtide.functions.registry import REGISTRY, UnknownFunction
from gridtide.functions.select import group
from gridtide.operators import index
from gridtide.operators.grid import ceil_to, consolidate
from gridtide.operators.rollup import READ
from gridtide.plans.retention import Retention, StorageRule, choose
from gridtide.series import SeriesList, seconds


class BadRequest(ValueError):
    """The request can't be answered as it is put."""


@dataclass(frozen=True)
class Pattern:
    """A path pattern, or seriesByTag(...) with its expressions."""

    text: str
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    named: dict = field(default_factory=dict)


# ---- targets ----------------------------------------------------------------------------------

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?=\s*(?:[,)]|$))")
_NAME = re.compile(r"(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^\s(){},|'\"])+")
_NAMED = re.compile(r"\s*([A-Za-z_]\w*)\s*=(?!~)\s*")
_WORDS = {"true": True, "false": False, "none": None}


def parse(target: str) -> Pattern | Call:
    """The expression of a whole target."""
    found, at = _expression(target, 0)
    if target[at:].strip():
        raise BadRequest(f"{target!r} isn't read from {target[at:]!r} on")
    if not isinstance(found, Pattern | Call):
        raise BadRequest(f"{target!r} is neither a pattern nor a call")
    return found


def _skipped(s: str, at: int) -> int:
    while at < len(s) and s[at] == " ":
        at += 1
    return at


def _expression(s: str, at: int, argument: bool = False):
    """A call, pattern or literal that begins at a place, with all that it is piped into; and where it ends."""
    at = _skipped(s, at)
    if at < len(s) and s[at] in "'\"":
        end = s.find(s[at], at + 1)
        if end < 0:
            raise BadRequest(f"a string isn't closed: {s[at:]!r}")
        return s[at + 1 : end], end + 1
    if argument and (m := _NUMBER.match(s, at)):
        text = m.group()
        return (int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)), m.end()
    m = _NAME.match(s, at)
    if not m:
        raise BadRequest(f"an expression is missing at {s[at:]!r}")
    name, at = m.group(), m.end()
    if at < len(s) and s[at] == "(":
        args, named, at = _arguments(s, at)
        found = _called(name, args, named)
    elif argument and name.lower() in _WORDS:
        return _WORDS[name.lower()], at
    else:
        found = Pattern(name)
    while (bar := _skipped(s, at)) < len(s) and s[bar] == "|":
        m = _NAME.match(s, _skipped(s, bar + 1))
        if not m or not s.startswith("(", m.end()):
            raise BadRequest(f"a function must follow the pipe at {s[bar:]!r}")
        args, named, at = _arguments(s, m.end())
        found = _called(m.group(), [found, *args], named)
    return found, at


def _arguments(s: str, at: int) -> tuple[list, dict, int]:
    args, named = [], {}
    at = _skipped(s, at + 1)
    while not s.startswith(")", at):
        if m := _NAMED.match(s, at):
            named[m[1]], at = _expression(s, m.end(), True)
        elif named:
            raise BadRequest(f"an argument without a name comes after named ones at {s[at:]!r}")
        else:
            value, at = _expression(s, at, True)
            args.append(value)
        at = _skipped(s, at)
        if s.startswith(",", at):
            at = _skipped(s, at + 1)
        elif not s.startswith(")", at):
            raise BadRequest(f"a call isn't closed: {s!r}")
    return args, named, at + 1


def _called(name: str, args: list, named: dict) -> Pattern | Call:
    if name == "seriesByTag":
        if not args or not all(isinstance(a, str) for a in args):
            raise BadRequest("seriesByTag takes tag expressions")
        return Pattern("seriesByTag(" + ",".join(f"'{a}'" for a in args) + ")", tuple(args))
    if name not in REGISTRY:
        raise UnknownFunction(name)
    return Call(name, tuple(args), named)


# ---- times ------------------------------------------------------------------------------------


def time_of(text: str | int, now: int, tz: str = "UTC") -> int:
    """Seconds of a time: a number of seconds, `now`, `-7d`, `now-1h`, or a date `20240131`, with a time of day `10:30_20240131`, in a time zone."""
    text = str(text).strip()
    if m := re.fullmatch(r"(?:now)?(?:([-+])(\w+))?", text):
        return now + (seconds(m[2]) * (1 if m[1] == "+" else -1) if m[1] else 0)
    if m := re.fullmatch(r"(?:(\d{1,2}):(\d{2})_)?(\d{8})", text):
        day = datetime.strptime(m[3], "%Y%m%d").replace(tzinfo=ZoneInfo(tz))
        return int((day.replace(hour=int(m[1]), minute=int(m[2])) if m[1] else day).timestamp())
    if text in ("today", "midnight", "yesterday"):
        day = datetime.fromtimestamp(now, ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0)
        return int((day - timedelta(days=text == "yesterday")).timestamp())
    if text.isdigit():
        return int(text)
    raise BadRequest(f"not a time: {text!r}")


# ---- stores -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Store:
    """definitions: sid, name, tags (map), interval[, last_update]; points: sid, ts, val; rollups: sid, span, ts, sum, cnt, min, max, lst.

    intervals: those of the raw points, if known. rules: the first whose pattern fits a name says which archives there are,
    the finest of which is the raw points. Archives are pruned by time, and if they are partitioned by it (as a column of
    their table) only the partitions that a range needs are read.
    """

    definitions: DataFrame
    points: DataFrame
    rollups: DataFrame | None = None
    rules: Sequence[StorageRule] = ()
    intervals: Sequence[int] | None = None


@dataclass(frozen=True)
class Range:
    """Times after start up to end, and by what points are consolidated where they are read."""

    start: int
    end: int
    how: str | None = None


def _archive(store: Store, wanted: Range, now: int) -> tuple[Column, list[int]]:
    """Which interval each series is read at (0: its raw points), by the rule for its name, and all those."""
    at, spans = F.lit(0), {0}
    for rule in reversed(store.rules):
        chosen: Retention = choose(rule.retentions, wanted.start, wanted.end, now)
        span = 0 if chosen == rule.retentions[0] else chosen.interval
        spans.add(span)
        at = F.when(F.col("name").rlike(index.checked(rule.pattern)), F.lit(span)).otherwise(at)
    return at, sorted(spans)


def fetch(store: Store, pattern: Pattern, wanted: Range, now: int, max_series: int | None = None) -> SeriesList:
    """The series a pattern finds, with their points in a range, on dense grids."""
    defs = index.find_by_tag(store.definitions, *pattern.tags) if pattern.tags else index.select(store.definitions, pattern.text)
    if max_series is not None and defs.limit(max_series + 1).count() > max_series:
        raise BadRequest(f"more than {max_series} series")
    at, spans = _archive(store, wanted, now)
    how = canonical(wanted.how or "average")
    defs = defs.withColumn("_span", at)
    raw = defs.withColumn("interval", F.when(F.col("_span") > 0, F.col("_span")).otherwise(F.col("interval")).cast("int"))
    series = raw.select("sid", "name", "tags", "interval", F.lit(pattern.text).alias("patt"), F.lit(how).alias("consolidator"), F.col("name").alias("target"), F.col("name").alias("ord"))
    parts = [_within(store.points, wanted).join(defs.where("_span = 0").select("sid"), "sid", "left_semi").select("sid", "ts", "val")]
    if len(spans) > 1:
        if store.rollups is None:
            raise BadRequest("the store has no rollups")
        val = F.try_divide("sum", "cnt") if how == "average" else F.col(READ.get(how, "sum")).cast("double")
        rolled = _within(store.rollups, wanted).where(F.col("span").isin(spans)).join(defs.select("sid", F.col("_span").alias("span")), ["sid", "span"])
        parts.append(rolled.select("sid", "ts", val.alias("val")))
    points = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # a slot has its earliest point, as it is stored with
    slots = points.join(series.select("sid", "interval"), "sid").groupBy("sid", ceil_to(F.col("ts"), F.col("interval")).alias("slot")).agg(F.min_by("val", "ts").alias("val"))
    known = None if store.intervals is None else [*store.intervals, *[s for s in spans if s]]
    sl = replace(SeriesList.of(series, slots.select("sid", F.col("slot").alias("ts"), "val"), known), consolidators=frozenset({how}))
    return sl.dense(wanted.start + 1, wanted.end)


def _within(points: DataFrame, wanted: Range) -> DataFrame:
    return points.where((F.col("ts") > wanted.start) & (F.col("ts") <= wanted.end))


# ---- answers ----------------------------------------------------------------------------------

# How users write the names of arguments.
_ARGUMENTS = {"func": "how", "xFilesFactor": "x_files_factor", "maxValue": "max_value", "alignToFrom": "align_to_from", "windowSize": "window", "intervalString": "interval", "default": "default", "n": "n", "natural": "natural", "reverse": "reverse", "limit": "limit", "base": "base", "startSourceAt": "source_start", "endSourceAt": "source_end", "total": "total", "precision": "precision", "start": "start", "stop": "stop"}
_WINDOWS = ("movingAverage", "movingMax", "movingMedian", "movingMin", "movingSum", "movingWindow")


def _ranges(call: Call, wanted: Range) -> tuple[Range, dict]:
    """The range of a call's lists, and what the function is told about the range asked for."""
    first = next((a for a in call.args if not isinstance(a, Pattern | Call)), None)
    if call.name in _WINDOWS:
        size = seconds(str(first).lstrip("+-"))
        return replace(wanted, start=wanted.start - size), {"start": wanted.start + 1}
    if call.name == "timeShift":
        by = seconds(str(first).lstrip("+-")) * (1 if str(first).startswith("+") else -1)
        return replace(wanted, start=wanted.start + by, end=wanted.end + by), {}
    if call.name in ("consolidateBy", "cumulative"):
        return replace(wanted, how=first or "sum"), {}
    if call.name in ("summarize", "smartSummarize"):
        return replace(wanted, how=None), {}
    return wanted, {}


def evaluate(store: Store, expression: Pattern | Call, wanted: Range, now: int, tz: str = "UTC", max_series: int | None = None) -> SeriesList:
    """An expression's list over a range."""
    if isinstance(expression, Pattern):
        return fetch(store, expression, wanted, now, max_series)
    if expression.name == "constantLine":
        return constant_line(store.points.sparkSession, float(expression.args[0]), wanted.start + 1, wanted.end + 1)
    if expression.name == "linearRegression":
        return _line(store, expression, wanted, now, tz, max_series)
    inner, told = _ranges(expression, wanted)
    value = lambda a: evaluate(store, a, inner, now, tz, max_series) if isinstance(a, Pattern | Call) else a
    args = [value(a) for a in expression.args]
    named = {_ARGUMENTS.get(k, k): value(v) for k, v in expression.named.items()} | told
    try:
        return REGISTRY[expression.name](*args, **named)
    except TypeError as e:
        raise BadRequest(f"{expression.name}: {e}") from e


def _line(store: Store, call: Call, wanted: Range, now: int, tz: str, max_series: int | None) -> SeriesList:
    """A line fitted on one range (that asked for, if none is given) and drawn over another."""
    given = [*call.args[1:], *call.named.values()]
    low = time_of(given[0], now, tz) if given else wanted.start + 1
    high = time_of(given[1], now, tz) if len(given) > 1 else wanted.end + 1
    whole = replace(wanted, start=min(low - 1, wanted.start), end=max(high, wanted.end))
    out = REGISTRY["linearRegression"](evaluate(store, call.args[0], whole, now, tz, max_series), low, high)
    return out.with_points(_within(out.points, wanted))


def render(store: Store, targets: str | Sequence[str], start: str | int, end: str | int = "now", *, now: int, max_points: int | None = None, tz: str = "UTC", max_series: int | None = None, max_slots: int | None = None) -> SeriesList:
    """The targets' lists, one after the other, at times after start up to end.

    max_points: at most so many points a series, by its consolidator.
    max_series: for each pattern; max_slots: of a series at one second at least, so a bound on the range asked for.
    """
    wanted = Range(time_of(start, now, tz), time_of(end, now, tz))
    if wanted.start >= wanted.end:
        raise BadRequest("the range is empty")
    if max_slots is not None and store.intervals and (wanted.end - wanted.start) // max(store.intervals) > max_slots:
        raise BadRequest(f"more than {max_slots} slots a series")
    lists = [evaluate(store, parse(t), wanted, now, tz, max_series) for t in ([targets] if isinstance(targets, str) else targets)]
    out = lists[0] if len(lists) == 1 else group(*lists)
    return out if max_points is None else consolidate(out, max_points)


def explain(targets: str | Sequence[str]) -> list[Pattern | Call]:
    """What is read from the targets: patterns and calls. (What Spark does is told by the result's points.explain().)"""
    return [parse(t) for t in ([targets] if isinstance(targets, str) else targets)]
