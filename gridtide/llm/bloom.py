"""Bloom filters of bounded size, built by Spark and asked inside tasks. Keys are well mixed 64-bit numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: a filter has 16 bits a key, between a megabyte and 16 megabytes. A filter of more keys than that holds
#: fewer apart, so more rows are moved where it is asked; none are lost.
LEAST_WORDS, MOST_WORDS = 1 << 17, 1 << 21
_SHIFTS = (0, 32)
_U = np.uint64


def build(keys: DataFrame, words: int | None = None) -> np.ndarray:
    """From one column of keys, which nulls leave out. The bits are put together by word, so no more than `words` rows (of 16 bytes) reach the driver."""
    key = F.col(keys.columns[0])
    keys = keys.where(key.isNotNull())
    if words is None:
        words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (keys.count() // 4).bit_length()))
    places = F.array(*[F.shiftrightunsigned(key, s).bitwiseAND(F.lit(words * 64 - 1)) for s in _SHIFTS])
    bits = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(words, np.int64)
    rows = bits.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def holds(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (as unsigned numbers) may be in the filter; those put in always are."""
    found = np.ones(len(keys), bool)
    for s in _SHIFTS:
        p = (keys >> _U(s)) & _U(len(bloom) * 64 - 1)
        found &= (bloom[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) == 1
    return found
