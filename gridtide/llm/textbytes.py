"""Vectorised byte-level helpers for Arrow batches inside Spark tasks.

Text columns arrive as Arrow buffers; these helpers cut a batch into runs of rows
of about a megabyte, so that the numpy work arrays stay a few dozen megabytes
whatever a batch holds, and hash spans of bytes without making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else _BASE_INV
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: White space as str.split has it for bytes: space and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(name)
    return (col.fill_null("") if col.null_count else col).cast(pa.large_string())


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..last (exclusive), their bytes, and offsets (rows + 1) into those bytes."""
    n = len(col)
    if not n:
        return
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class SpanHasher:
    """64-bit hashes of any spans of one byte array, by differences of a running polynomial."""

    def __init__(self, data: np.ndarray, codes: np.ndarray | None = None):
        codes = _BYTE_CODE[data] if codes is None else codes
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        if len(codes):
            np.cumsum(codes * _power("up", len(codes))[: len(codes)], out=self.prefix[1:])
        self.down = _power("down", len(codes) + 1)

    @classmethod
    def of_codes(cls, codes: np.ndarray) -> SpanHasher:
        """For characters given as 64-bit codes."""
        return cls(codes, codes)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(span ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside gap (a table of 256 flags) within each row: row, start, end."""
    return runs(~gap[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true places within each row: row, start, end."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)  # a row begins here
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, starts, ends


def split_rows(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets (n_rows + 1) of the sorted row numbers."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
