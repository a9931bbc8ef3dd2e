"""Benchmark decontamination by a distributed positional inverted index.

The training side is stored as postings (term, text, position) of the terms that matter for the test items. A window of
an item (ten consecutive words, or a shorter item as a whole) is looked up from its rarest term: each posting of it says where
the window would begin, and there the list of the next rarest term, shifted by the terms' offsets, must have a place within a
slack. What both lists agree on is verified in the text: all words in their order are an exact
phrase, most of the words within the slack are a proximity match.

Terms are 64-bit hashes of words, texts are told by a hash (equal ones are searched once). The distinct words of
the items are counted and indexed VOCABULARY at a time, so what goes to all tasks is bounded, however many items there are;
the lists are joined by term, text and place, and no list is gathered anywhere. Null texts have no words; documents and
items without words match nothing, whatever their ids. Rows, repeated ones and those with null ids too, are kept one for
one; items may repeat, and count once by id. Texts and items may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm import bloom, textbytes
from gridtide.llm.spaces import Scratch

WINDOW = 10
#: Terms of a window whose lists are intersected.
RAREST = 2
#: By how many words terms may stand elsewhere in a proximity match, and the share of a window's distinct terms that it has there.
SLACK, NEAR_SHARE = 2, 0.8
#: Terms that are sent to all tasks at once (8 bytes each).
VOCABULARY = 2_000_000

_U = np.uint64
#: Word bytes after lower-casing A-Z: digits, a-z, and all bytes of characters beyond ASCII.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and term (a 64-bit hash as int64) of each word."""
    data = textbytes.LOWER[data]
    rows, starts, ends = textbytes.words(data, offsets, _GAP)
    return rows, textbytes.SpanHasher(data)(starts, ends).view(np.int64)


def _member(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the terms are among the (sorted) wanted ones."""
    if not len(wanted):
        return np.zeros(len(terms), bool)
    return wanted[np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)] == terms


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, number, terms: the windows of each item."""
    kind = items.schema[item_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = textbytes.column_of(batch, "_text")
            for first, last, data, offsets in textbytes.chunks(col):
                rows, terms = _terms(data, offsets)
                at = textbytes.split_rows(rows, last - first)
                who, number, lists = [], [], []
                for r in range(last - first):
                    own = terms[at[r] : at[r + 1]]
                    for k in range(max(1, len(own) - size + 1) if len(own) else 0):
                        who.append(first + r)
                        number.append(k)
                        lists.append(own[k : k + size])
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(who, pa.int64())), pa.array(number, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "number", "terms"])

    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")).mapInArrow(run, f"item_id {kind.simpleString()}, number int, terms array<bigint>")


def term_counts(docs: DataFrame, wanted: np.ndarray, text: str = "text") -> DataFrame:
    """term, n: occurrences in all documents of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wanted), np.int64)  # one task's sums
        for batch in batches:
            for _, _, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                _, terms = _terms(data, offsets)
                counts += np.bincount(np.searchsorted(wanted, terms[_member(terms, wanted)]), minlength=len(wanted))
        seen = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen]), pa.array(counts[seen])], ["term", "n"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _copies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's hash, as Spark's xxhash64."""
    raw = data.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[a:b], seed=42) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64).view(np.int64)


def postings(docs: DataFrame, wanted: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of the wanted terms: doc_id, copy (the text's hash), term, position, n_words. Each document also has one row with a null term, and with its number of words."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                rows, terms = _terms(data, offsets)
                at, copy, n = textbytes.split_rows(rows, last - first), _copies(data, offsets), last - first
                found = np.flatnonzero(_member(terms, wanted))
                who = np.concatenate([np.arange(n), rows[found]])
                none = np.concatenate([np.ones(n, bool), np.zeros(len(found), bool)])
                out = [
                    batch.column("doc_id").take(pa.array(first + who)),
                    pa.array(copy[who]),
                    pa.array(np.concatenate([np.zeros(n, np.int64), terms[found]]), mask=none),
                    pa.array(np.concatenate([np.zeros(n, np.int64), found - at[rows[found]]]), mask=none),
                    pa.array(np.diff(at).astype(np.int64)[who]),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "copy", "term", "position", "n_words"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind.simpleString()}, copy bigint, term bigint, position bigint, n_words bigint")


def _place_key(copy: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of a place in a text."""
    return textbytes.mix(copy.view(np.uint64) + start.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def words_at(docs: DataFrame, places: DataFrame, before: int, behind: int, text: str = "text") -> DataFrame:
    """copy, start, words: of each place (copy, start) in a text the terms from `before` before it on, `behind` of them from it on.

    Nulls stand where the text has none. A Bloom filter of bounded size keeps most other places from being moved.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("copy", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(_place_key(copy, start))], ["key"])

    kept = bloom.build(places.select("copy", "start").mapInArrow(keyed, "key bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # texts that this task has had, as far as it remembers
        for batch in batches:
            for first, last, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                rows, terms = _terms(data, offsets)
                at, copy = textbytes.split_rows(rows, last - first), _copies(data, offsets)
                if len(seen) > 1_000_000:
                    seen.clear()
                new = np.array([not (c in seen or seen.add(c)) for c in copy.tolist()], bool)
                position = np.arange(len(terms)) - at[rows]
                found = np.flatnonzero(new[rows] & bloom.holds(kept, _place_key(copy[rows], position).view(np.uint64)))
                around = found[:, None] + np.arange(-before, behind)
                outside = (around < at[rows[found]][:, None]) | (around >= at[rows[found] + 1][:, None])
                lists = terms[np.clip(around, 0, max(len(terms) - 1, 0))] if len(terms) else around
                values = pa.array(lists.ravel(), mask=outside.ravel())
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (before + behind)), values)
                yield pa.RecordBatch.from_arrays([pa.array(copy[rows[found]]), pa.array(position[found]), words], ["copy", "start", "words"])

    found = docs.select(F.col(text).alias("_text")).mapInArrow(run, "copy bigint, start bigint, words array<bigint>")
    return found.join(places.select("copy", "start").distinct(), ["copy", "start"], "left_semi").dropDuplicates(["copy", "start"])


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """windows (window, terms) with the rarest terms that documents have: places, an array of struct(term, offset), the rarest first. Windows without any are left out."""
    each = windows.select("window", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    places = F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, rarest)  # of as many as a window has words
    return each.groupBy("window").agg(F.any_value("terms").alias("terms"), places.alias("p")).select("window", "terms", F.transform("p", lambda x: F.struct(x.term.alias("term"), x.offset.cast("long").alias("offset"))).alias("places"))


def candidates(index: DataFrame, anchors: DataFrame, slack: int = SLACK) -> DataFrame:
    """copy, window, start: where the lists of a window's rarest terms, shifted by their offsets, agree within slack."""
    wide = 2 * slack + 1
    held = index.where(F.col("term").isNotNull())
    # positions of a term in one text by stretches of `wide` words: no more than that many in a row, and equal texts' are one
    lists = held.groupBy("copy", "term", F.floor(F.col("position") / wide).alias("stretch")).agg(F.collect_set("position").alias("positions"))
    first, second = F.get("places", F.lit(0)), F.get("places", F.lit(1))
    anchors = anchors.select("window", first.term.alias("term"), first.offset.alias("offset"), second.term.alias("other"), (second.offset - first.offset).alias("shift"))
    own = lists.join(anchors, "term").select("copy", "window", "offset", "other", "shift", F.explode("positions").alias("position"))
    begin = F.col("position") - F.col("offset")
    own = own.where(begin >= -slack).withColumn("start", F.greatest(begin, F.lit(0)))
    alone = own.where("other IS NULL").select("copy", "window", "start")
    expected = F.col("position") + F.col("shift")
    stretches = F.array_distinct(F.array(F.floor((expected - slack) / wide), F.floor((expected + slack) / wide)))
    asked = own.where("other IS NOT NULL").select("copy", "window", "start", expected.alias("expected"), F.col("other").alias("term"), F.explode(stretches).alias("stretch"))
    both = asked.join(lists, ["copy", "term", "stretch"]).where(F.exists("positions", lambda p: F.abs(p - F.col("expected")) <= slack))
    return alone.unionByName(both.select("copy", "window", "start")).distinct()


def matches(docs: DataFrame, found: DataFrame, anchors: DataFrame, size: int, text: str = "text", slack: int = SLACK, share: float = NEAR_SHARE) -> DataFrame:
    """copy, window, start, length, exact: candidates that the texts confirm, as a whole phrase or as a proximity match."""
    words = words_at(docs, found, slack, size + slack, text)
    both = found.join(anchors.select("window", "terms"), "window").join(words, ["copy", "start"])
    length = F.size("terms")
    exact = F.slice("words", slack + 1, length) == F.col("terms")
    distinct = F.array_distinct("terms")
    near = F.size(F.array_intersect(distinct, F.slice("words", F.lit(1), length + 2 * slack))) >= F.ceil(F.lit(share) * F.size(distinct))
    return both.select("copy", "window", "start", length.alias("length"), F.coalesce(exact, F.lit(False)).alias("exact"), near.alias("near")).where("exact OR near").drop("near")


def _vocabularies(windows: DataFrame) -> Iterator[np.ndarray]:
    """The windows' distinct terms, sorted, about VOCABULARY at a time."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    parts = -(-terms.count() // VOCABULARY)
    for k in range(parts):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).toArrow()
        yield np.sort(own.column("term").to_numpy())


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id, copy, n_words, n_hit, items (sorted distinct ids as strings), n_near (items near which the text comes by proximity matches) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # a window is told by its terms: rows with one id may have different ones, and items may share some
    of_items = scratch.written(item_windows(items, item_id, size=size).select(F.col("item_id").cast("string").alias("item"), F.xxhash64("terms").alias("window"), "terms"), "windows")
    windows = of_items.groupBy("window").agg(F.any_value("terms").alias("terms"))
    counts = [term_counts(docs, own, text) for own in _vocabularies(windows)]
    none = docs.sparkSession.createDataFrame([], "term bigint, n bigint")
    counts = scratch.written(reduce(DataFrame.unionByName, counts, none), "counts")
    anchors = scratch.written(rarest_terms(windows, counts), "anchors")
    parts = [postings(docs, own, doc_id, text) for own in _vocabularies(anchors.select(F.expr("places.term").alias("terms")))] or [postings(docs, np.zeros(0, np.int64), doc_id, text)]
    index = scratch.written(reduce(DataFrame.unionByName, [parts[0], *[p.where("term IS NOT NULL") for p in parts[1:]]]), "postings")
    rows = index.where(F.col("term").isNull())
    rows = rows.select("doc_id", "copy", "n_words")
    found = scratch.written(candidates(index, anchors, slack), "candidates")
    hits = scratch.written(matches(docs, found, anchors, size, text, slack), "matches")
    exact = hits.where("exact")
    # words inside any window: each stretch counts what reaches beyond those that begin before it
    by_place = exact.groupBy("copy", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = Window.partitionBy("copy").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    by_place = by_place.withColumn("_from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = by_place.groupBy("copy").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("_from"))).alias("n_hit"))
    own_items = of_items.select("item", "window").distinct()
    by_item = hits.groupBy("copy", "window").agg(F.max("exact").alias("exact")).join(own_items, "window").groupBy("copy", "item").agg(F.max("exact").alias("exact"))
    by_copy = by_item.groupBy("copy").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near"))
    out = rows.join(by_copy.join(n_hit, "copy", "left"), "copy", "left")
    return out.select("doc_id", "copy", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
