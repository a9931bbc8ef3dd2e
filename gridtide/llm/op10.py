"""op10: a toxicity score for every document, learnt from the labelled rows that aren't held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.tables import table
from gridtide.llm.toxicity import Lexicon, learn, score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def lexicon_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Lexicon:
    return learn(docs, table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, lexicon_of(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        "n_matches",
    )


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
