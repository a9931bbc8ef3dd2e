"""op2: licence notices in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.license_scan import TEMPLATES, WORD, scan_licenses
from gridtide.llm.tables import table

LEAST_SHARE = 0.5


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, least_share=LEAST_SHARE).select("doc_id", "n_words", "matches", F.filter("matches", lambda m: m.base).alias("base"))
    starts = F.transform("base", lambda m: m.start)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"),
        _labels(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0)), 9).alias("score"),
    )


def _sql() -> str:
    rows = []
    for t in TEMPLATES:
        words, key = t.words.split(), t.key.split()
        begin = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append(f"('{t.label}', {t.base}, {words}, {key}, {begin})")
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
t(label, base, words, key, begin) AS (VALUES {", ".join(rows)}),
p AS (
  SELECT w.r, t.label, t.base, t.words, t.begin, w.ws,
         unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = key[1] AND ws[i:i + len(key) - 1] = key)) AS i
  FROM w, t),
q AS (
  SELECT r, label, base, i - begin - 1 AS start,
         len(list_filter(range(1, len(words) + 1), lambda j: i - begin + j - 1 >= 1 AND coalesce(ws[i - begin + j - 1], '') = words[j])) / len(words) AS share
  FROM p),
m AS (SELECT * FROM q WHERE base OR share >= {LEAST_SHARE}),
g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM m GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 9) AS score
FROM w LEFT JOIN g USING (r)"""


QUERIES = {"op2_license_scan": op2_license_scan}
SQL = {"op2_license_scan": _sql()}
