"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the hashes of its distinct word n-grams. Tokens are put in one order for all
documents: rare ones first, then the frequent class, by hash within either. Two sets as alike
as the threshold asks share a token among their first n - ceil(t n) + 1 (the prefix), and two tokens
among one more. Rare tokens are indexed alone; for frequent ones the prefix is extended and pairs of tokens are
indexed, where sets are short enough for that (COMBINED; sets near that length have both).
Sets that meet in the index must fit by length, by what their positions leave to be shared, and by their
sketches: parities of how many tokens are in each of 1,024 classes (more for large sets), which can't differ in more classes
than the sets have tokens of their own. Then the whole sets are compared.

Only the components are asked for, so not all pairs of a large group are looked at: neighbours in each
list are compared first, and then only those pairs of a list that aren't in one component yet, each in the first
list that both sets are in (as far as the first ones of each tell). Equal
sets are one node from the beginning. Which tokens are frequent is told by a Bloom filter of fixed size: a
wrong answer of it puts a token elsewhere in the order, for all documents alike, and loses nothing.

Nodes are 64-bit digests of sets. Ids may be of any type that has an order. Null and empty texts have empty sets, linked with nothing; rows
with one id are one document. Rows with a null id are documents told by their texts; they link as others do, and
their component id is null (repeated() tells which of them are copies). Every row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm import bloom, textbytes
from gridtide.llm.components import components
from gridtide.llm.spaces import Scratch

#: A token in so many sets is of the frequent class (a set counts again where a task has forgotten it).
FREQUENT = 32
#: The longest prefix for which pairs of frequent tokens are indexed.
COMBINED = 40
#: 64-bit numbers in a sketch of a set of fewer than 2,048 tokens, which double with its size (so that classes aren't
#: fewer than the tokens in which linked sets may differ).
SKETCH = 16
#: In lists, sets of so many tokens or more carry so many numbers folded from their sketch, in a struct of this name.
CARRIED = (("s", 0, 4), ("w", 1024, 16), ("v", 4096, 32))
#: So many of a set's first lists are carried with it, so that a pair is made in one of them only.
FRONT = 8
#: Tokens counted at once in a task and, about, in a part of the tokens; digests of sets that a task has seen.
COUNTED, PART, SEEN = 4_000_000, 1 << 19, 1_000_000

_U = np.uint64


def shingle_rows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct k-word shingle, by row and hash; a row of fewer words, but not none, has one of them all."""
    data = textbytes.LOWER[data]
    rows, starts, ends = textbytes.words(data, offsets, textbytes.SPACE)
    h = textbytes.SpanHasher(data)(starts, ends)
    at = textbytes.split_rows(rows, len(offsets) - 1)
    n = np.diff(at)
    factors = textbytes.mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    whole = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        whole += h[j : j + len(whole)] * factors[j]
    inside = rows[: len(whole)] == rows[len(rows) - len(whole) :] if len(whole) else np.zeros(0, bool)
    out_rows, out = rows[: len(whole)][inside], textbytes.mix(whole[inside])
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            short[has] += h[at[few[has]] + j] * factors[j]
        out_rows, out = np.concatenate([out_rows, few]), np.concatenate([out, textbytes.mix(short + n[few].astype(np.uint64))])
    order = np.lexsort((out, out_rows))
    out_rows, out = out_rows[order], out[order]
    first = np.ones(len(out), bool)
    first[1:] = (out_rows[1:] != out_rows[:-1]) | (out[1:] != out[:-1])
    return out_rows[first], out[first]


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their rows' offsets, and for each row its set's size and digest."""
    rows, tokens = shingle_rows(data, offsets, k)
    at = textbytes.split_rows(rows, len(offsets) - 1)
    n = np.diff(at)
    total = np.concatenate([[_U(0)], np.cumsum(textbytes.mix(tokens ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return tokens, at, n, textbytes.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)


def set_digests(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), n, node, sketch for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                tokens, _, n, node = _sets(data, offsets, k)
                long = np.int64(1) << np.maximum(0, np.frexp(n)[1].astype(np.int64) - 11)
                begins = np.concatenate([[0], np.cumsum(SKETCH * long)])
                sketch = np.zeros(begins[-1], np.uint64)
                place = np.repeat(begins[:-1], n) + ((tokens >> _U(6)) & np.repeat((SKETCH * long - 1).astype(np.uint64), n)).astype(np.int64)
                np.bitwise_xor.at(sketch, place, _U(1) << (tokens & _U(63)))
                sketches = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(sketch.view(np.int64)))
                own = [batch.column(c).slice(first, last - first) for c in ("doc_id", "copy")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(node), sketches], ["doc_id", "copy", "n", "node", "sketch"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, copy bigint, n bigint, node bigint, sketch array<bigint>")


class _New:
    """Which sets a task hasn't seen yet (as far as it remembers)."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, node: np.ndarray, n: np.ndarray) -> np.ndarray:
        if len(self.seen) > SEEN:
            self.seen.clear()
        out = np.zeros(len(node), bool)
        for i, (x, c) in enumerate(zip(node.tolist(), n.tolist(), strict=True)):
            if c and x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _token_parts(tokens: np.ndarray, parts: int) -> pa.RecordBatch:
    """part, tokens, n: the distinct tokens and how often each of them is there, by part (the tokens' first bits)."""
    tokens, n = np.unique(tokens, return_counts=True)
    part = tokens >> _U(64 - parts.bit_length() + 1)
    first = np.flatnonzero(part[1:] != part[:-1]) + 1
    at = pa.array(np.concatenate([[0], first, [len(tokens)]]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (tokens.view(np.int64), n.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(part[np.concatenate([[0], first])].view(np.int64)), *lists], ["part", "tokens", "n"])


def frequent_tokens(docs: DataFrame, k: int, scratch: Scratch, size: int, text: str = "text") -> np.ndarray:
    """A Bloom filter of tokens that are in FREQUENT sets or more. size is about how many tokens there are, repeated ones too.

    Nearly all tokens are in one set only, so rows of one token each would cost more than to count them: what a task has seen goes by
    parts of the tokens, as arrays, and each part is summed up by itself.
    """
    parts, least = 1 << max(6, (size // PART).bit_length()), FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, waiting, held = _New(), [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            if held:
                out = _token_parts(np.concatenate(waiting), parts)
                for first in range(0, len(out), 64):
                    yield out.slice(first, 64)

        for batch in batches:
            for _, _, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                tokens, _, n, node = _sets(data, offsets, k)
                waiting.append(tokens[np.repeat(new(node, n), n)])
                held += len(waiting[-1])
                if held > COUNTED:
                    yield from counted()
                    waiting, held = [], 0
        yield from counted()

    def often(part: pa.Table) -> pa.Table:
        tokens, n = (pc.list_flatten(part.column(c)).to_numpy() for c in ("tokens", "n"))
        order = np.argsort(tokens)
        tokens = tokens[order]
        first = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1])
        return pa.table({"token": tokens[first[np.add.reduceat(n[order], first, dtype=np.int64) >= least]]})

    seen = docs.select(F.col(text).alias("_text")).mapInArrow(run, "part bigint, tokens array<bigint>, n array<int>")
    return bloom.build(scratch.written(seen.groupBy("part").applyInArrow(often, "token bigint"), "frequent"))


def _prefixes(tokens: np.ndarray, at: np.ndarray, n: np.ndarray, take: np.ndarray, frequent: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, row, first and position of the index entries of the rows to take.

    first is the place of the (first) token. position is that of a single token, or the one before a pair's second
    token: sets for which the key is the first that they share have no more in common than what is behind it.
    """
    rows = np.repeat(np.arange(len(n)), n)
    often = bloom.holds(frequent, tokens)
    order = np.lexsort((tokens, often, rows))
    tokens, often = tokens[order], often[order]
    position = np.arange(len(tokens)) - at[rows]
    prefix = n - -(-t.numerator * n // t.denominator) + 1
    inside = take[rows] & (position < prefix[rows])
    # pairs of tokens for sets of up to this size, single ones from this size on: two sets of one component's pair share a kind
    most = int(COMBINED / (1 - t))
    alone = ~often | (n[rows] * t.denominator >= most * t.numerator)
    single = np.flatnonzero(inside & alone)
    keys, who, firsts, places = [tokens[single]], [rows[single]], [position[single]], [position[single]]
    for i in np.flatnonzero(inside & often & (n[rows] * t.numerator <= most * t.denominator)):
        r = rows[i]
        rest = np.arange(i + 1, at[r] + min(prefix[r] + 1, n[r]))
        keys.append(textbytes.mix(tokens[i] * _U(3) + tokens[rest]))
        who.append(np.full(len(rest), r))
        firsts.append(np.full(len(rest), position[i]))
        places.append(position[rest] - 1)  # of the first two shared tokens
    return np.concatenate(keys), np.concatenate(who), np.concatenate(firsts), np.concatenate(places)


def index_entries(docs: DataFrame, k: int, t: Fraction, frequent: np.ndarray, text: str = "text") -> DataFrame:
    """key, node, n, first, position: the prefix index of all distinct sets (a set may be in it more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for batch in batches:
            for _, _, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                tokens, at, n, node = _sets(data, offsets, k)
                keys, who, firsts, places = _prefixes(tokens, at, n, new(node, n), frequent, t)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[who]), pa.array(n[who].astype(np.int32)), pa.array(firsts.astype(np.int32)), pa.array(places.astype(np.int32))], ["key", "node", "n", "first", "position"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "key bigint, node bigint, n int, first int, position int")


def token_sets(docs: DataFrame, wanted: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, tokens (sorted) of the wanted documents (node, key: the id's hash). A Bloom filter of bounded size keeps most others from being moved; no texts are."""
    kept = bloom.build(wanted.select(F.col("node").bitwiseXOR(F.col("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("key").to_numpy()
            for first, last, data, offsets in textbytes.chunks(textbytes.column_of(batch, "_text")):
                tokens, at, n, node = _sets(data, offsets, k)
                take = bloom.holds(kept, (node ^ ids[first:last]).view(np.uint64))
                own = np.concatenate([[0], np.cumsum(n[take])])
                lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(tokens[np.repeat(take, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[take]), pa.array(ids[first:last][take]), lists], ["node", "key", "tokens"])

    found = docs.select(F.xxhash64(doc_id).alias("key"), F.col(text).alias("_text")).mapInArrow(run, "node bigint, key bigint, tokens array<bigint>")
    return found.join(wanted, ["node", "key"], "left_semi").dropDuplicates(["node", "key"]).select("node", "tokens")


def _may_link(n: Column, p: Column, m: Column, q: Column, t: Fraction) -> Column:
    """Whether sets of sizes n and m that share no token before positions p and q can be as alike as t."""
    shared = F.least(n - p, m - q).cast("long")
    return shared * (t.numerator + t.denominator) >= (n.cast("long") + m) * t.numerator


def _few_apart(bits: Column, n: Column, m: Column, t: Fraction) -> Column:
    """Whether sets of sizes n and m that have so many tokens alone, or more, can be as alike as t."""
    return bits.cast("long") * (t.numerator + t.denominator) <= (n.cast("long") + m) * (t.denominator - t.numerator)


def _folded(sketch: str, n: Column) -> Column:
    """A sketch brought to n numbers (a power of two, not above its own)."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(i, F.size(sketch) - 1, n), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(sketch, j))))


def _by_sketches(pairs: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    least = F.least(F.size("s_a"), F.size("s_b"))
    bits = F.aggregate(F.zip_with(_folded("s_a", least), _folded("s_b", least), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return pairs.join(one, "a").join(two, "b").where(_few_apart(bits, F.col("n_a"), F.col("n_b"), t)).select("a", "b")


def lists_with_fronts(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """List entries (key, node, n, position, component) with their sets' sketches, and in `before` those of the set's FRONT first lists that come before the entry's."""
    place = F.struct("position", "key")
    front = held.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(place)), 1, FRONT).alias("front"))  # of no more than a set's prefix has
    folded = nodes.select("node", *[F.when(F.col("n") >= least, _folded("sketch", F.lit(many))).alias(c) for c, least, many in CARRIED])
    folded = folded.select("node", *[F.when(F.col(c).isNotNull(), F.struct(*[F.get(c, F.lit(i)).alias(f"_{i}") for i in range(many)])).alias(c) for c, _, many in CARRIED])
    before = F.transform(F.filter("front", lambda e: e < place), lambda e: e.key)
    return held.join(front, "node").join(folded, "node").withColumn("before", before).drop("front")


def open_pairs(lists: DataFrame, t: Fraction) -> DataFrame:
    """a, b: pairs of a list that aren't in one component and that positions and sketches allow to be linked.

    A pair isn't made where both sets are in one list before: its positions there are no larger in either set, so it is made there or
    still before. Which lists come before is told for each set's first ones, so few pairs are made more than once.
    """
    x, y = lists.alias("x"), lists.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _may_link(F.col("x.n"), F.col("x.position"), F.col("y.n"), F.col("y.position"), t)
    for c, _, many in CARRIED:
        bits = reduce(Column.__add__, [F.bit_count(F.col(f"x.{c}._{i}").bitwiseXOR(F.col(f"y.{c}._{i}"))) for i in range(many)])
        apart &= F.coalesce(_few_apart(bits, F.col("x.n"), F.col("y.n"), t), F.lit(True))  # null where not both have it
    return x.join(y, apart & ~F.arrays_overlap("x.before", "y.before")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Of the pairs (a, b), those whose sets are as alike as t."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return two.where(shared * (t.numerator + t.denominator) >= (F.size("x").cast("long") + F.size("y")) * t.numerator).select("a", "b")


def similar_components(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents are linked from the Jaccard index threshold on (exactly, as a fraction)."""
    # the components' least ids; documents of one id, and those with equal sets, are one
    component = F.when(F.col("n") > 0, F.least("least", "doc_id")).otherwise(F.col("doc_id"))
    return _grouped(docs, k, threshold, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def repeated(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy (null, or where the id is null the text's hash) of documents that aren't the first of their component: the one of least id, or if all ids are null of least hash."""
    of_null = F.col("least").isNotNull() | (F.col("copy") > F.col("least_copy"))
    rows = _grouped(docs, k, threshold, doc_id, text).where((F.col("n") > 0) & F.when(F.col("doc_id").isNull(), of_null).otherwise(F.col("least") < F.col("doc_id")))
    return rows.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("copy")).alias("copy")).distinct()


def _grouped(docs: DataFrame, k: int, threshold: Fraction, doc_id: str, text: str) -> DataFrame:
    """doc_id, copy, n, least and least_copy (of the component's ids and hashes) for every row."""
    t = Fraction(threshold)
    scratch = Scratch(docs.sparkSession, "ngram_join")
    digests = scratch.written(set_digests(docs, k, doc_id, text), "digests")
    size = digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = frequent_tokens(docs, k, scratch, size, text)
    by_key = Window.partitionBy("key").orderBy("n", "node")
    entries = index_entries(docs, k, t, frequent, text)
    whole = Window.partitionBy("key")
    listed = entries.withColumns({"lo": F.min("node").over(whole), "hi": F.max("node").over(whole)}).where("lo != hi").drop("lo", "hi")
    before = F.lag(F.struct("node", "n", "first")).over(by_key)
    listed = scratch.written(listed.withColumn("before", before), "lists")
    nodes = scratch.written(digests.where("n > 0").groupBy("node").agg(F.xxhash64(F.min("doc_id")).alias("key"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "nodes")

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs, by the whole sets of one document for each node."""
        pairs = scratch.written(_by_sketches(pairs, nodes, t), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = scratch.written(nodes.select("node", "key").join(ends, "node", "left_semi"), "wanted")
        out = scratch.written(_linked(pairs, token_sets(docs, wanted, k, doc_id, text), t), "links")
        scratch.drop(pairs, wanted)
        return out

    # neighbours in each list
    near = listed.where(F.col("before").isNotNull() & (F.col("before.node") != F.col("node")))
    near = near.where(_may_link(F.col("n"), F.col("first"), F.col("before.n"), F.col("before.first"), t))  # of any key, not only of the first shared one
    near = near.select(F.least("node", "before.node").alias("a"), F.greatest("node", "before.node").alias("b")).distinct()
    links = linked(near)
    joined = scratch.written(components(links, scratch), "joined")

    # all other pairs of a list that aren't in one component
    known = listed.drop("before", "first").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    held = known.join(several, "key").repartition("node").distinct()
    open_lists = scratch.written(lists_with_fronts(held, nodes), "open")
    pairs = open_pairs(open_lists, t)
    apart = pairs.distinct().join(near, ["a", "b"], "left_anti")
    more = linked(apart)
    joined = scratch.written(components(links.unionByName(more), scratch), "components")
    scratch.drop(listed, nodes, links, more, open_lists)

    rows = digests.drop("sketch").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.min("copy").alias("least_copy"))
    return rows.join(least, "component", "left")
