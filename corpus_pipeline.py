"""A corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.decontaminate import find_contamination
from gridtide.llm.line_dedup import BLANK, dedup_lines
from gridtide.llm.ngram_join import repeated
from gridtide.llm.op5 import default_model
from gridtide.llm.op10 import lexicon_of
from gridtide.llm.sentencepiece_codec import encode
from gridtide.llm.spaces import written
from gridtide.llm.tables import table
from gridtide.llm.toxicity import score


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name of theirs meets one of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(True)).alias("_rest"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The lexicon is learnt from labelled rows that aren't held out.

    Null and empty texts match nothing and stay, as do null ids and repeated rows, each by its own text.
    """
    return _unpacked(score(_packed(docs), lexicon_of(spark, docs, sf_dir)).where("score < 0.5"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go but for the first; so do documents of which nothing else is left.

    Null and empty texts stay. Null ids come first in the order; rows equal in id and text are one document and all stay.
    """
    out = dedup_lines(_packed(docs))
    fewer = F.col("n_exact") + F.col("n_near") > 0
    nothing_left = fewer & (F.trim("text", F.lit(BLANK + "\n")) == "")
    out = out.where(~F.coalesce(nothing_left, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", F.when(fewer, F.length("text").cast(kind)).otherwise(F.col("_rest.n_chars"))))
    return _unpacked(out, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard index of 0.8 or more, that of the least id stays (null ids come last, by the text's hash).

    Null and empty texts are linked with nothing and stay; rows of one id are one document.
    """
    others = repeated(docs.select("doc_id", "text"), k=5, threshold=Fraction(4, 5)).select(F.col("doc_id").alias("_other"), F.coalesce("copy", F.lit(0)).alias("_hash"))
    packed = _packed(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_other")) & (F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0) == F.col("_hash"))
    return _unpacked(packed.join(others, same, "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or all of a shorter one) go. Texts without words stay, whatever their ids."""
    found = find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("copy").distinct()
    packed = _packed(docs)
    return _unpacked(packed.join(found.select(F.col("copy").alias("_hash")), F.xxhash64("text") == F.col("_hash"), "left_anti"), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids (of a null text: none), their number, and whether decoding gives the text back; columns of docs with these names give way."""
    coded = encode(docs.drop("ids", "decoded", "n_tokens", "restored"), default_model(), decoded="decoded")
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "restored": F.col("decoded") == F.coalesce("text", F.lit(""))}).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_tokens),
]

#: The lexicon is learnt, which SQL can't express; each stage is tested against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
