"""op7: secrets in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.secrets_scan import scan_secrets
from gridtide.llm.tables import table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op7_secrets(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, vocabulary or default_vocabulary()).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "token")],
        F.sha2(_joined(F.filter("spans", lambda s: s.kind != "token")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secrets": op7_secrets}
SQL: dict[str, str] = {}
