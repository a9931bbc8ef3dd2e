"""Document fingerprints from improbable features.

Every window of WINDOW bytes has an entropy; how often each (rounded) entropy occurs over the whole corpus
ranks windows by rarity. In each run of RUN neighbouring windows the rarest, leftmost
one gets a vote, and windows with VOTES votes or more are the text's features. Features go,
in order, into a chain of Bloom filters of FILTER_BITS bits, a new one after each FEATURES features.
Two chains are compared filter by filter, by the overlap of their bits beyond
what chance gives, as a share of the most that is possible.

Of a text under SHORT bytes, too short to choose among its windows, all runs of TINY bytes are
features (the whole text, if it is shorter still); an empty or null text has none, and an empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm import textbytes

WINDOW, RUN, VOTES = 32, 32, 8
SHORT, TINY = 96, 8
FILTER_BITS, FEATURES, HASHES = 2048, 160, 5
BINS = 1001
#: Windows of lower entropy (in thousandths of the most) are no features where others are near.
WEAK = 100

_SCALE = 1 << 20
_n = np.arange(1, WINDOW + 2, dtype=np.float64)
#: What the n-th equal byte adds to a window's sum of n log n, in whole units so that sums don't depend on their order.
_STEP = np.concatenate([[0], np.rint(np.diff(np.concatenate([[0.0], _n * np.log2(_n)])) * _SCALE)]).astype(np.int64)
_MOST = int(WINDOW * np.log2(WINDOW) * _SCALE)
_NONE = np.int64(1 << 40)  # the rank where no window may begin


def entropy_bins(x: np.ndarray) -> np.ndarray:
    """The entropy of each window of x, in thousandths of the most; one for each place where a window fits."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    ahead, behind = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)  # equal bytes within a window's reach
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    total = np.empty(n, np.int64)
    counts = np.bincount(x[:WINDOW], minlength=256)
    total[0] = sum(int(_STEP[1 : c + 1].sum()) for c in counts)
    total[1:] = _STEP[behind[WINDOW:] + np.intp(1)] - _STEP[ahead[: n - 1] + np.intp(1)]
    return ((_MOST - np.cumsum(total)) * (BINS - 1) // _MOST).clip(0, BINS - 1).astype(np.int16)


def _fitting(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of the n places are the beginning of a window within one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + WINDOW <= ends


def entropy_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """bin, n: how many windows of all texts have each entropy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, _, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                bins = entropy_bins(data)
                counts += np.bincount(bins[_fitting(offsets, len(bins))], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(counts)], ["bin", "n"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def rarity_ranks(counts: Iterable[tuple[int, int]]) -> np.ndarray:
    """Rank of each entropy, 0 for the rarest; weak ones come after all others."""
    n = np.zeros(BINS, np.int64)
    for b, c in counts:
        n[b] = c
    order = np.lexsort((np.arange(BINS), n, np.arange(BINS) < WEAK))
    ranks = np.empty(BINS, np.int64)
    ranks[order] = np.arange(BINS)
    return ranks


def _chosen(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Beginnings of the windows with VOTES votes or more."""
    bins = entropy_bins(data)
    if not len(bins):
        return np.zeros(0, np.int64)
    at = np.arange(len(bins), dtype=np.int64)
    key = (np.where(_fitting(offsets, len(bins)), ranks[bins], _NONE) << 22) + at
    # runs also begin before the first window and reach beyond the last; texts are further apart than a run is long
    best = np.concatenate([np.full(RUN - 1, _NONE << 22), key, np.full(RUN - 1, _NONE << 22)])
    step = 1
    while step < RUN:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = best[best < _NONE << 22]
    return np.flatnonzero(np.bincount(best & ((1 << 22) - 1), minlength=len(bins)) >= VOTES) if len(best) else np.zeros(0, np.int64)


def _features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature, by row and then place, each once a row."""
    starts = _chosen(data, offsets, ranks)
    rows = np.searchsorted(offsets, starts, "right") - 1
    sizes = np.diff(offsets)
    long = sizes[rows] >= SHORT
    rows, starts = rows[long], starts[long]
    ends = starts + WINDOW
    brief = np.flatnonzero((sizes > 0) & (sizes < SHORT))
    n = np.maximum(1, sizes[brief] - TINY + 1)
    more = np.repeat(brief, n)
    begin = offsets[more] + np.arange(len(more)) - np.repeat(np.cumsum(n) - n, n)
    rows, starts, ends = np.concatenate([rows, more]), np.concatenate([starts, begin]), np.concatenate([ends, np.minimum(begin + TINY, offsets[more + 1])])
    hashes = textbytes.SpanHasher(data)(starts, ends)
    order = np.lexsort((starts, hashes, rows))
    rows, starts, hashes = rows[order], starts[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, starts, hashes = rows[first], starts[first], hashes[first]
    order = np.lexsort((starts, rows))
    return rows[order], hashes[order]


def digests(texts: list[bytes], ranks: np.ndarray, most: int = textbytes.CHUNK_BYTES) -> list[np.ndarray]:
    """For each text its filters, one a row, as bytes. Texts are taken together up to `most` bytes, and longer ones in parts of that size; the result doesn't depend on it."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= most:
            size += len(texts[last])
            last += 1
        own = texts[first:last]
        if size > most:
            hashes = _features_by_parts(own[0], ranks, most)
            out += _filters(np.zeros(len(hashes), np.int64), hashes, 1)
        else:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
            rows, hashes = _features(np.frombuffer(b"".join(own), np.uint8), offsets, ranks)
            out += _filters(rows, hashes, len(own))
        first = last
    return out


def _features_by_parts(text: bytes, ranks: np.ndarray, size: int) -> np.ndarray:
    """The features of one text of SHORT bytes or more, part by part: what decides on a window is within a run and a window of it."""
    margin, found = RUN + WINDOW, []
    for first in range(0, len(text), size):
        low = max(0, first - margin)
        x = np.frombuffer(text[low : first + size + margin], np.uint8)
        starts = _chosen(x, np.array([0, len(x)], np.int64), ranks)
        starts = starts[(starts >= first - low) & (starts < first - low + size)]
        found.append(textbytes.SpanHasher(x)(starts, starts + WINDOW))
    hashes = np.concatenate(found)
    _, at = np.unique(hashes, return_index=True)  # each once, where it stands first
    return hashes[np.sort(at)]


def _filters(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> list[np.ndarray]:
    at = textbytes.split_rows(rows, n_rows)
    n = -(-np.diff(at) // FEATURES)
    base = np.concatenate([[0], np.cumsum(n)])
    which = base[rows] + (np.arange(len(rows)) - at[rows]) // FEATURES
    bits = np.zeros(int(base[-1]) * FILTER_BITS, bool)
    for k in range(HASHES):
        bits[which * FILTER_BITS + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits).reshape(-1, FILTER_BITS // 8)
    return [packed[base[r] : base[r + 1]] for r in range(n_rows)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, weighted by its bits."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    a, b = a.view(np.uint64), b.view(np.uint64)
    of_a, of_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for x, n in zip(a, of_a, strict=True):
        shared = np.bitwise_count(b & x).sum(1, dtype=np.int64)
        chance, most = n * of_b / FILTER_BITS, np.minimum(n, of_b)
        score = (shared - chance) / np.maximum(most - chance, 1e-9)
        total += n * float(score.max().clip(0, 1))
    return float(total / of_a.sum())


def text_of(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def digest_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BITS // 8)


def ranks_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity ranks from all texts; BINS counts are all that reaches the driver."""
    return rarity_ranks((r.bin, r.n) for r in entropy_counts(docs, text).collect())


def fingerprint(docs: DataFrame, ranks: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text (base64 of its filters). Every row is kept."""
    fields = [f for f in docs.schema.fields if f.name != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = textbytes.column_of(batch, text)
            texts = [t.encode() for t in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array([text_of(d) for d in digests(texts, ranks)], pa.string())], [*[f.name for f in fields], name])

    return docs.select(*[f.name for f in fields]).mapInArrow(run, schema)
