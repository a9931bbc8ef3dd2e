"""op1: fingerprints of every document and of a text made from it and the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.fingerprints import BINS, digests, entropy_counts, likeness, rarity_ranks, text_of
from gridtide.llm.tables import table

#: Documents are dealt to blocks of neighbouring ids, of about so many bytes, and at most so many blocks.
BLOCK_BYTES, MOST_BLOCKS = 8 << 20, 20_000


def block_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the bounds (descending) are above an id: blocks in descending order of ids. Two steps, each short."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]).cast("array<bigint>")
    whole = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    passed = F.size(F.filter(coarse, lambda b: b > doc_id)) * step
    return (passed + F.size(F.filter(F.slice(whole, passed + 1, F.lit(step)), lambda b: b > doc_id))).cast("int")


def with_next(docs: DataFrame, n_blocks: int) -> DataFrame:
    """block, last (false), id, text of every row, and for each block a row with last = true: the row that comes after it.

    Rows are in descending order of id (null ids last, equal ids by the text's hash), and after the last comes the first.
    """
    least = -(1 << 63)
    docs = docs.select(F.col("doc_id"), F.coalesce("doc_id", F.lit(least)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    probabilities = [k / n_blocks for k in range(1, n_blocks)]
    bounds = sorted({int(b) for b in docs.approxQuantile("id", probabilities, 1 / (4 * n_blocks))}, reverse=True) if probabilities else []
    docs = docs.withColumn("block", block_of(F.col("id"), bounds)).withColumn("hash", F.xxhash64("text")).withColumn("last", F.lit(False))
    # the first row of each block, of which there are MOST_BLOCKS at most
    heads = sorted(docs.groupBy("block").agg(F.max(F.struct("id", "hash")).alias("h")).collect(), key=lambda r: r.block)
    before = [(heads[k - 1].block, r.h.id, r.h.hash) for k, r in enumerate(heads)]  # for block 0 that is the last one
    ends = docs.sparkSession.createDataFrame(before, "end_of int, id long, hash long")
    ends = docs.drop("block", "last").join(F.broadcast(ends), ["id", "hash"]).groupBy("end_of").agg(F.any_value("text").alias("text"))
    ends = ends.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("id"), "text", F.col("end_of").alias("block"), F.lit(None).cast("long").alias("hash"), F.lit(True).alias("last"))
    return docs.unionByName(ends)


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited(text: str, following: str) -> str:
    """The last third of the text's characters replaced by as many of the following text's first (or all)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [(r.bin, r.n) for r in entropy_counts(docs).collect()]  # BINS rows
    ranks = rarity_ranks(counts)
    assert len(ranks) == BINS
    n_blocks = min(MOST_BLOCKS, 1 + sum(n for _, n in counts) // BLOCK_BYTES)
    rows = with_next(docs, n_blocks).repartition("block").sortWithinPartitions("block", "last", F.desc("id"), F.desc("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (id, text) of rows whose next one isn't known, or isn't worked through
        chars = 0
        for batch in batches:
            ids, texts, lasts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("last").to_pylist()
            for i, t, last in zip(ids, texts, lasts, strict=True):
                waiting.append((i, t))
                chars += len(t)
                if last or chars > 1 << 20:
                    if len(waiting) > 1:
                        yield _worked(waiting, ranks, batch.schema.field("doc_id").type)
                    waiting, chars = ([], 0) if last else (waiting[-1:], len(t))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "last").mapInArrow(run, schema)


def _worked(rows: list[tuple], ranks: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Results of all rows but the last, which is only the next of the one before it."""
    texts = [t for _, t in rows]
    changed = [edited(t, u).encode() for t, u in zip(texts, texts[1:], strict=False)]
    own, other = digests([t.encode() for t in texts], ranks), digests(changed, ranks)
    columns = [
        pa.array([i for i, _ in rows[:-1]], kind),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
        pa.array([text_of(d) for d in own[:-1]]),
        pa.array([text_of(d) for d in other]),
        pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, _OUT)


QUERIES = {"op1_fingerprints": op1_fingerprints}
SQL: dict[str, str] = {}
