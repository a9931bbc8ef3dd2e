"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

The regression is fitted on a small labelled URL table (at most MAX_LABELLED rows, a
bound of the table and not of what is judged); scoring is DataFrame expressions only.
A null url, or one without ://, has an empty host and path, and the verdict of the bias and two signs. Urls of any
length are scored whole. Every row is kept, repeated ones too; an empty table gives one.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
MAX_RULES = 1_000

#: The small labelled table: url, unwanted (1 or 0). Its hosts are made up; gambling, drugs, adult, advertising, spam, fraud and warez against ordinary sites in four languages.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Endings and paths under which each labelled host counts too, so that these tell little by themselves.
ENDINGS, PATHS = ("com", "net", "org", "info"), ("/", "/en/12", "/de/7.html", "/fr/345/", "/es/61?page=2")


def labelled_urls(path: str | Path = LABELLED) -> list[tuple[str, int]]:
    """A labelled table's rows, from a file of the package by default (on the driver, where the model is fitted), and for each its host's longest name under other endings, as a domain and below one that both labels share."""
    with open(path, encoding="utf-8", newline="") as f:
        own = [(r["url"], int(r["unwanted"])) for r in csv.DictReader(f, delimiter="\t")]
    names = [(max(url.split("/")[2].split("."), key=len), label) for url, label in own]
    return own + [(f"https://{name}{below}.{e}{PATHS[(i + k) % len(PATHS)]}", label) for i, (name, label) in enumerate(names) for k, e in enumerate(ENDINGS) for below in ("", ".example")]


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (as host then path) that fits, as struct(text, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    best = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def ngram_slots(host: Column, path: Column, sizes: Sequence[int], dimension: int) -> Column:
    """Distinct slots of the hashed character n-grams of ^host and path$."""
    whole = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(whole, i, F.lit(n))), F.lit(dimension)))

    return F.array_distinct(F.concat(*map(of_size, sizes)))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]], sizes: Sequence[int] = (3, 4, 5), dimension: int = 1 << 18, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps over the whole labelled table, in which both labels count alike.

    Rows are kept as their slots alone, so memory and time grow with the n-grams of at most MAX_LABELLED urls.
    """
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    url = F.col("url")
    rows = spark.createDataFrame(list(labelled), "url string, label int").select("label", ngram_slots(host_of(url), path_of(url), sizes, dimension).alias("slots")).collect()
    whole = np.zeros(dimension)
    if not rows:
        return whole, 0.0
    n = np.array([len(r.slots) for r in rows])
    used, slots = np.unique(np.concatenate([np.array(r.slots, np.int64) for r in rows]), return_inverse=True)
    who = np.repeat(np.arange(len(rows)), n)
    scale = 1 / np.sqrt(np.maximum(n, 1))
    y = np.array([r.label for r in rows], float)
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    # a row's features have a length of 1, so with the bias the loss curves by 1/4 * 2 at most
    step, weights, bias, ahead, ahead_bias = 1 / (0.5 + l2), np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for k in range(rounds):
        z = scale * np.bincount(who, ahead[slots], len(rows)) + ahead_bias
        g = (1 / (1 + np.exp(-z)) - y) * each
        new = ahead - step * (np.bincount(slots, (g * scale)[who], len(used)) + l2 * ahead)
        new_bias, go_on = ahead_bias - step * g.sum(), k / (k + 3)
        ahead, ahead_bias = new + go_on * (new - weights), new_bias + go_on * (new_bias - bias)
        weights, bias = new, new_bias
    whole[used] = weights
    return whole, float(bias)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], labelled: Sequence[tuple[str, int]] | None = None, url: str = "url", threshold: float = 0.5, sizes: Sequence[int] = (3, 4, 5), dimension: int = 1 << 18) -> DataFrame:
    """pages with host, path, rule (its text, or null), unwanted (the regression's probability) and verdict."""
    weights, bias = train(pages.sparkSession, labelled_urls() if labelled is None else labelled, sizes, dimension)
    table = F.split(F.lit(",".join(f"{v:.6g}" for v in weights)), ",").cast("array<double>")  # one constant
    cut = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    slots = ngram_slots(F.col("host"), F.col("path"), sizes, dimension)
    cut = cut.withColumn("_slots", slots).withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    total = F.aggregate("_slots", F.lit(0.0), lambda acc, s: acc + F.get(table, s.cast("int")))
    z = total / F.sqrt(F.greatest(F.lit(1), F.size("_slots"))) + F.lit(float(bias))
    cut = cut.withColumn("unwanted", 1 / (1 + F.exp(-z)))
    method = F.when(F.col("unwanted") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return cut.withColumns({"rule": F.col("_rule.text"), "verdict": F.coalesce(F.col("_rule.verdict"), method)}).drop("_slots", "_rule")
