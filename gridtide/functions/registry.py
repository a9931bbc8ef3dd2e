"""Functions by the names their users know them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.series import SeriesList

REGISTRY: dict[str, Callable[..., SeriesList]] = {}


def register(*names: str):
    def keep(f):
        for n in names:
            if n in REGISTRY:
                raise ValueError(f"{n} is registered twice")
            REGISTRY[n] = f
        return f

    return keep


def called(col: str, call: str) -> Column:
    before, after = call.split("{}")
    return F.concat(F.lit(before), col, F.lit(after))


def tagged(**tags: str) -> Column:
    """A series' tags with these put in or replaced."""
    old = F.map_filter("tags", lambda k, v: ~k.isin(*tags))
    return F.map_concat(old, F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]))


def renamed(sl: SeriesList, call: str, **tags: str) -> SeriesList:
    """Targets and patterns put into a call, "f({}, 1)", and tags that say so."""
    series = sl.series.withColumns({"target": called("target", call), "patt": called("patt", call)})
    return sl.with_series(series.withColumn("tags", tagged(**tags)) if tags else series)


class UnknownFunction(KeyError):
    """No function has this name."""


def apply(name: str, *args, **kwargs) -> SeriesList:
    if name not in REGISTRY:
        raise UnknownFunction(name)
    return REGISTRY[name](*args, **kwargs)
