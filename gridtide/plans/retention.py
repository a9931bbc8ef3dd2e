"""Which archive of a series answers a request: small rules on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from gridtide.series import seconds


@dataclass(frozen=True)
class Retention:
    """Points each `interval` seconds, kept for `ttl` seconds, readable from `ready` on."""

    interval: int
    ttl: int
    ready: int = 0

    @staticmethod
    def of(text: str) -> Retention:
        """interval:ttl[:...]"""
        interval, ttl, *rest = text.split(":")
        ready = rest[2] if len(rest) > 2 else "true"
        return Retention(seconds(interval), seconds(ttl), int(ready) if ready.isdigit() else 0 if ready == "true" else 1 << 62)


@dataclass(frozen=True)
class StorageRule:
    name: str
    pattern: str
    retentions: tuple[Retention, ...]

    @staticmethod
    def of(name: str, pattern: str, retentions: str) -> StorageRule:
        kept = tuple(Retention.of(r.strip()) for r in retentions.split(","))
        for a, b in zip(kept, kept[1:], strict=False):
            if b.interval <= a.interval or b.interval % a.interval or b.ttl < a.ttl:
                raise ValueError(f"{name}: intervals must be growing multiples, and times to live must not fall")
        return StorageRule(name, pattern, kept)


def rule_for(name: str, rules: list[StorageRule]) -> StorageRule | None:
    """The first rule that fits a name."""
    return next((r for r in rules if re.search(r.pattern, name)), None)


def choose(retentions: tuple[Retention, ...], start: int, end: int, now: int, max_points: int = 0) -> Retention:
    """The finest archive that holds the whole time from start on and is ready; the one held longest, if none does. With max_points, a coarser one that still has so many points."""
    able = [r for r in retentions if now - r.ttl <= start and r.ready <= start] or [max(retentions, key=lambda r: r.ttl)]
    if max_points:
        fitting = [r for r in able if (end - start) // r.interval >= max_points]
        return fitting[-1] if fitting else able[0]
    return able[0]


# Which stored aggregates answer a wanted one, the best first.
ROLLUP_PREFERENCE = {
    "average": ("average", "last", "max", "min", "sum"),
    "min": ("min", "last", "average", "max", "sum"),
    "max": ("max", "last", "average", "min", "sum"),
    "sum": ("sum", "last", "average", "max", "min"),
    "last": ("last", "average", "max", "min", "sum"),
}


def closest_rollup(wanted: str, stored: list[str]) -> str:
    """The stored aggregate that answers `wanted`, or comes nearest to it."""
    return next((x for x in ROLLUP_PREFERENCE.get(wanted, (wanted,)) if x in stored), stored[0])
