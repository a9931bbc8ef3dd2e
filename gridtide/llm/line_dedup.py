"""Line dedup by a segment-partition edit join.

Lines that are equal, or within a few edits of one another,
form classes (chains of such links included); of each class the line that comes first by document id and
line number stays, and the others go. So many edits are allowed as the shorter line's length gives: `edits` says from which
length on one is, two are, and so on (EDITS by default, at most 30 of them); shorter lines must be equal. Blank lines (of white space alone) always stay.

A line is cut into one segment more than edits allowed; a line within that distance holds one of
the segments unchanged, nearly at its place. Segments are indexed with the line's length and their number, and
each line looks up those of its substrings that can be segments of lines of its length or slightly
shorter. Lines that meet are compared by a banded bit-parallel edit distance,
many pairs at a time; before that, pairs go whose sketches differ in more bits than so many edits can change
(parities of the counts of 128 classes of words, of which an edit adds and removes three at most, and of 64 classes of
characters, of which it adds and removes two at most). As only classes are asked for, each list's lines are compared with
its first indexed one, and afterwards only lines of a list that aren't in one class yet. Equal lines are one node from
the beginning (by two hashes, 96 bits).

Null texts have one empty line and stay null. Rows that are equal in id and text are one document; all are kept. Null ids
come first in the order. Lines and texts of any length are looked at whole. An empty table gives one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm import bloom, textbytes
from gridtide.llm.components import components
from gridtide.llm.spaces import Scratch

LEAST_CHARS = 1
#: One edit from 24 characters on, two from 48 on. Look-ups, and the work with them, grow with the cube of the edits.
EDITS = (24, 48)
BLANK = " \t\r\x0b\f"

_U = np.uint64
_CODE = textbytes.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def edits_allowed(n, edits: Sequence[int] = EDITS):
    """Of a line of n characters (a number or an array)."""
    return np.searchsorted(np.array(edits), n, "right")


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), line (from 0), node, check (hashes of the line), chars: all lines but blank ones."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n")).alias("line", "_text"))
    chars = F.length("_text")
    return each.where((chars >= LEAST_CHARS) & (F.length(F.trim("_text", F.lit(BLANK))) > 0)).select("doc_id", "copy", "line", F.xxhash64("_text").alias("node"), F.hash("_text").alias("check"), chars.alias("chars"))


def segments(n: int, edits: Sequence[int] = EDITS) -> list[tuple[int, int]]:
    """(start, end) of the segments of a line of n characters: as even as can be, longer ones last."""
    m = int(edits_allowed(n, edits)) + 1
    short, longer = n // m, n % m
    sizes = [short + (i >= m - longer) for i in range(m)]
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def lookups(n: int, edits: Sequence[int] = EDITS) -> list[tuple[int, int, int, int, bool]]:
    """(length, segment's number, start, end, whether it's the line's own segment) of what a line of n characters looks up."""
    found = []
    for size in range(max(edits[0], n - len(edits)), n + 1):
        more, k = n - size, int(edits_allowed(size, edits))
        if more > k:
            continue
        for i, (s, e) in enumerate(segments(size, edits)):
            low, high = max(s - i, s + more - (k - i), 0), min(s + i, s + more + (k - i), n - (e - s))
            found += [(size, i, at, at + e - s, size == n and at == s) for at in range(low, high + 1)]
    return found


def index_keys(docs: DataFrame, text: str = "text", edits: Sequence[int] = EDITS) -> DataFrame:
    """key, node, indexed: segments and look-ups of all lines for which edits are allowed (a line may come more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple[np.ndarray, ...]] = {}
        seen: set[int] = set()
        for batch in batches:
            col = textbytes.column_of(batch, "_text")
            for first, last, _, _ in textbytes.chunks(col):
                nodes, lines = [], []
                for t in col.slice(first, last - first).to_pylist():
                    for x in t.split("\n"):
                        if len(x) >= edits[0] and x.strip(BLANK):
                            node = xxhash.xxh64_intdigest(x.encode(), seed=42)  # as Spark's xxhash64
                            if node not in seen:
                                seen.add(node)
                                nodes.append(node)
                                lines.append(x)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not lines:
                    continue
                _, begins, hasher = _characters(lines)
                starts, ends, salts, own, who = [], [], [], [], []
                for k, x in enumerate(lines):
                    if len(x) not in plans:
                        if len(plans) > 20_000:
                            plans.clear()
                        got = np.array(lookups(len(x), edits), np.int64).reshape(-1, 5)
                        plans[len(x)] = (got[:, 2], got[:, 3], textbytes.mix((got[:, 0] * (len(edits) + 2) + got[:, 1]).astype(np.uint64)), got[:, 4].astype(bool))
                    s, e, salt, mine = plans[len(x)]
                    starts.append(s + begins[k])
                    ends.append(e + begins[k])
                    salts.append(salt)
                    own.append(mine)
                    who.append(len(s))
                keys = textbytes.mix(hasher(np.concatenate(starts), np.concatenate(ends)) ^ np.concatenate(salts))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(np.array(nodes, np.uint64).view(np.int64), who)), pa.array(np.concatenate(own))], ["key", "node", "indexed"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "key bigint, node bigint, indexed boolean")


def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, textbytes.SpanHasher]:
    """The lines' characters in one array, the lines' offsets in it, and a hasher of spans."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    codes = np.where(chars < (1 << 16), _CODE[np.minimum(chars, (1 << 16) - 1)], textbytes.mix(chars.astype(np.uint64) + _U(1)))
    return chars, begins, textbytes.SpanHasher.of_codes(codes)


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit numbers for each line: for each of 128 classes of words, and of 64 classes of characters, whether the line has an odd number of such."""
    chars, begins, hasher = _characters(lines)
    rows, starts, ends = textbytes.runs(chars != 32, begins)
    h = hasher(starts, ends)
    bit, high = _U(1) << (h & _U(63)), (h >> _U(6)) & _U(1) == 1
    out = []
    for half in (~high, high):
        sketch = np.zeros(len(lines), np.uint64)
        np.bitwise_xor.at(sketch, rows[half], bit[half])
        out.append(sketch.view(np.int64))
    letters = np.zeros(len(lines), np.uint64)
    filled = np.flatnonzero(np.diff(begins))
    if len(filled):
        letters[filled] = np.bitwise_xor.reduceat(_U(1) << (chars.astype(np.uint64) & _U(63)), begins[filled])
    return out[0], out[1], letters.view(np.int64)


def within_edits(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most `most` (under 31): Hyyrö's bit-parallel algorithm along a diagonal band, for all pairs at once."""
    n = len(left)
    if not n:
        return np.zeros(0, bool)
    one = [a if len(a) >= len(b) else b for a, b in zip(left, right, strict=True)]
    two = [b if len(a) >= len(b) else a for a, b in zip(left, right, strict=True)]
    size1, size2 = np.array([len(a) for a in one]), np.array([len(b) for b in two])
    most = np.asarray(most, np.int64)
    possible = size1 - size2 <= most
    wide = int(most.max())
    flat = lambda rows: np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat1, flat2 = flat(one), flat(two)
    at1, at2 = np.cumsum(size1) - size1, np.cumsum(size2) - size2
    top, all_ones = _U(63), _U(0xFFFFFFFFFFFFFFFF)
    vp = all_ones << (top - most.astype(np.uint64))
    vn = np.zeros(n, np.uint64)
    distance = most.copy()
    across = np.full(n, 62, np.uint64)
    for i in range(int(size2.max(initial=0))):
        live = i < size2
        c = flat2[np.where(live, at2 + i, 0)] if len(flat2) else np.zeros(n, np.uint32)
        x = np.zeros(n, np.uint64)
        for k in range(2 * wide + 1):  # the bit 63 - k stands for place i + most - k of the longer line
            j = i + most - k
            ok = (j >= 0) & (j < size1) & live
            same = ok & (flat1[np.where(ok, at1 + j, 0)] == c)
            x |= same.astype(np.uint64) << _U(63 - k)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        down = i < size1 - most  # along the diagonal, and at the longer line's end across
        step = np.where(down, 1 - (d0 >> top).astype(np.int64), ((hp >> across) & _U(1)).astype(np.int64) - ((hn >> across) & _U(1)).astype(np.int64))
        distance = np.where(live, distance + step, distance)
        across = np.where(live & ~down, across - _U(1), across)
        vp, vn = np.where(live, hn | ~((d0 >> _U(1)) | hp), vp), np.where(live, (d0 >> _U(1)) & hp, vn)
    return possible & (distance <= most)


def _texts(docs: DataFrame, nodes: DataFrame, text: str, least: int) -> DataFrame:
    """node, line, s1, s2, s3 (its sketches): the lines of the nodes. A Bloom filter of fixed size keeps nearly all other lines from being moved."""
    kept = bloom.build(nodes.select("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = textbytes.column_of(batch, "_text")
            for first, last, _, _ in textbytes.chunks(col):
                found: dict[int, str] = {}
                for t in col.slice(first, last - first).to_pylist():
                    for x in t.split("\n"):
                        if len(x) >= least:
                            found.setdefault(xxhash.xxh64_intdigest(x.encode(), seed=42), x)
                keys = np.array(list(found), np.uint64)
                take = bloom.holds(kept, keys)
                lines = [found[k] for k in keys[take].tolist()]
                parts = [pa.array(keys[take].view(np.int64)), pa.array(lines, pa.string()), *map(pa.array, sketches(lines))]
                yield pa.RecordBatch.from_arrays(parts, ["node", "line", "s1", "s2", "s3"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "node bigint, line string, s1 bigint, s2 bigint, s3 bigint").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _linked(pairs: DataFrame, texts: DataFrame, edits: Sequence[int]) -> DataFrame:
    """Of the pairs (a, b), those within the edits allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = np.minimum(pdf["x"].str.len(), pdf["y"].str.len()).to_numpy(np.int64)
            order, good = np.argsort(n, kind="stable"), np.zeros(len(pdf), bool)
            for part in np.array_split(order, max(1, len(order) // 2_000)):  # pairs of about one length together
                good[part] = within_edits(pdf["x"].iloc[part].tolist(), pdf["y"].iloc[part].tolist(), edits_allowed(n[part], edits))
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    return both.mapInPandas(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, scratch: Scratch, text: str = "text", edits: Sequence[int] = EDITS) -> DataFrame:
    """node, component: lines with others within the edits allowed; lines without such aren't listed."""
    by_key = Window.partitionBy("key")
    keys = index_keys(docs, text, edits)
    entries = keys.withColumn("n", F.count("*").over(by_key)).where("n > 1").withColumn("head", F.min(F.when(F.col("indexed"), F.col("node"))).over(by_key))
    other = F.max(F.col("node") != F.col("head")).over(by_key)
    entries = scratch.written(entries.where(F.col("head").isNotNull()).withColumn("other", other).where("other").drop("n", "other"), "lists")
    nodes = scratch.written(entries.select("node").distinct(), "nodes")
    texts = scratch.written(_texts(docs, nodes, text, edits[0]), "lines")
    sketched = texts.select("node", F.length("line").alias("n"), "s1", "s2", "s3")
    lists = scratch.written(entries.join(sketched, "node"), "sketched")
    scratch.drop(entries, nodes)

    of_heads = sketched.select(*[F.col(c).alias(f"head_{c}" if c != "node" else "head") for c in sketched.columns])
    heads = lists.where("node != head").join(of_heads, "head").where(_may_link("", "head_", edits))
    heads = scratch.written(heads.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "heads")
    links = scratch.written(_linked(heads, texts, edits), "links")
    joined = scratch.written(components(links, scratch), "joined")

    known = lists.drop("head").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    open_lists = scratch.written(known.join(several, "key").distinct(), "open")
    scratch.drop(lists)
    x, y = open_lists.where("indexed").alias("x"), open_lists.alias("y")
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _may_link("x.", "y.", edits))
    apart = apart.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    apart = scratch.written(apart.join(heads, ["a", "b"], "left_anti"), "apart")
    more = scratch.written(links.unionByName(_linked(apart, texts, edits)), "more")
    out = scratch.written(components(more, scratch), "classes")
    scratch.drop(texts, heads, links, joined, open_lists, apart, more)
    return out


def _may_link(one: str, other: str, edits: Sequence[int]) -> Column:
    """Whether the lengths and sketches of two lines (columns with these prefixes) allow them to be within the edits allowed."""
    n, m = F.col(f"{one}n"), F.col(f"{other}n")
    differ = [F.bit_count(F.col(f"{one}{s}").bitwiseXOR(F.col(f"{other}{s}"))) for s in ("s1", "s2", "s3")]
    most = F.lit(1)
    for k, length in enumerate(edits[1:], 2):
        most = F.when(F.least(n, m) >= length, k).otherwise(most)
    return (F.abs(n - m) <= most) & (differ[2] <= 2 * most) & (differ[0] + differ[1] <= 3 * most)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: Sequence[int] = EDITS) -> DataFrame:
    """docs with text rewritten, and n_lines, n_exact and n_near: lines, and those that went because an equal or a near one came before."""
    if not edits or list(edits) != sorted(edits) or len(edits) > 30:
        raise ValueError("edits must be rising lengths, 30 at most")
    scratch = Scratch(docs.sparkSession, "line_dedup")
    lines = scratch.written(lines_of(docs, doc_id, text), "all_lines")
    near = near_classes(docs, scratch, text, edits)
    place = F.struct("doc_id", "copy", "line")
    equal = lines.groupBy("node", "check").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # lines with near ones are told by their component, others by both hashes
    equal = equal.join(near, "node", "left").withColumn("alone", F.when(F.col("component").isNull(), F.col("check")).otherwise(0)).withColumn("component", F.coalesce("component", "node"))
    classes = equal.groupBy("component", "alone").agg(F.sum("n").alias("all"), F.min("first").alias("least"))
    listed = equal.join(classes.where("all > 1"), ["component", "alone"]).select("node", "check", "first", "least")
    gone = lines.join(listed, ["node", "check"]).where(~place.eqNullSafe(F.col("least")))
    by_doc = gone.groupBy("doc_id", "copy").agg(
        F.collect_set("line").alias("_gone"),
        F.count_distinct(F.when(F.col("first") != F.col("least"), F.col("line"))).alias("_near"),
    )
    out = docs.withColumns({"_id": F.col(doc_id), "_copy": F.xxhash64(text)})
    out = out.join(by_doc.select(F.col("doc_id").alias("_of"), F.col("copy").alias("_same"), "_gone", "_near"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_copy") == F.col("_same")), "left")
    own = F.split(text, "\n")
    kept = F.array_join(F.filter(own, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    n_gone = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    out = out.withColumns({
        "n_lines": F.coalesce(F.size(own), F.lit(1)).cast("long"),
        "n_exact": n_gone - F.coalesce("_near", F.lit(0)),
        "n_near": F.coalesce("_near", F.lit(0)).cast("long"),
        text: F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col(text)),
    })
    return out.drop("_id", "_copy", "_of", "_same", "_gone", "_near")
