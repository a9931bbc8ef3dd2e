"""op8: a verdict on every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.tables import table
from gridtide.llm.url_filter import Rule, judge_urls

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", F.round("unwanted", 6).alias("unwanted"))


QUERIES = {"op8_url_filter": op8_url_filter}
SQL: dict[str, str] = {}
