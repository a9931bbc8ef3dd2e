"""op3: repeated and nearly repeated lines of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.line_dedup import dedup_lines
from gridtide.llm.tables import table


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL: dict[str, str] = {}
