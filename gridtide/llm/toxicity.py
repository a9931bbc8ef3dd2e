"""Toxicity: a learnt, weighted lexicon matched by Aho-Corasick over folded text.

Folding maps letters that look alike and digits that stand for letters to plain
Latin letters, drops accents, and turns everything else into single spaces, so that
"1dіot" and "idiot" are one word. The lexicon is learnt from labelled documents: words and
word beginnings (stems) that are significantly commoner in toxic documents, weighted
by their log odds. A document's score is a logistic function of its weighted matches,
plain and divided by its length; matches inside exception phrases don't count.

Null and empty texts have no matches and get the score of a text without any. Every
row is kept, texts of any length are folded whole. A table without labels of both kinds gives an empty lexicon
and scores of 0. Of labelled rows with one id that have different labels the greatest counts, of documents with one id one text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.spaces import written

#: The lexicon is fitted on at most so many labelled documents, those least by a hash of their id.
FIT_DOCUMENTS = 12_000
STEM_LENGTHS = range(4, 11)

# Look-alike letters (Cyrillic, then Greek) and the digits and signs used for letters.
HOMOGLYPHS = str.maketrans("авеғкмнорстухіјѕԁԛԝҽαβεικνορτυχ", "abefkmhopctyxijsdqweabeikvoptux")
SUBSTITUTES = str.maketrans("0134578@$", "oieastbas")

EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "idiot proof", "sore loser clause", "stupid simple")

_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words with one space before, between and behind them; "" if there are none."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(HOMOGLYPHS))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = _GAP.sub(" ", text.translate(SUBSTITUTES)).strip()
    return f" {text} " if text else ""


@dataclass
class Lexicon:
    """Patterns over folded text (" stem", or " word "), their weights, exception phrases, and the score's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    bias: float = -50.0
    plain: float = 0.0
    by_length: float = 0.0

    def matcher(self):
        """An automaton of the patterns and exception phrases; values are (length, weight), or (length, None) for a phrase."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for e in self.exceptions:
            if p := fold(e):
                found.add_word(p, (len(p), None))
        if len(found):
            found.make_automaton()
        return found


def weighted_matches(folded: str, automaton) -> tuple[float, int]:
    """The sum of weights of the matches that no exception phrase covers, and their number; of nested stems of one word the heaviest counts."""
    if not folded or not len(automaton):
        return 0.0, 0
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            covered.append((start, end))
        else:
            best[start] = max(weight, best.get(start, weight))
    if covered:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in covered)}
    return sum(best.values()), len(best)


def features_of(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100.0 * total / max(words, 1))


def _candidates(folded: str) -> set[str]:
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(" " + w[:n] for n in STEM_LENGTHS if n < len(w))
    return found


def learn_counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """pattern, toxic, clean: in how many documents of either label each word and stem occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = (Counter(), Counter())
            for t, y in zip(pdf[text], pdf[label], strict=True):
                counts[int(y)].update(_candidates(fold(t or "")))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"pattern": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}, columns=["pattern", "toxic", "clean"])

    return labelled.select(text, label).mapInPandas(run, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """The lexicon and coefficients from docs whose ids are in labels (those given to fit on, and no others).

    Fitted on at most FIT_DOCUMENTS labelled documents, which bounds what reaches the driver: a row for each of them, and the
    patterns that are significant in them (all of them). Patterns whose surplus in toxic documents
    chance could explain (at one in a hundred for all patterns together) are left out, as are
    longer stems that tell no more than a shorter one. A stem that stands for nearly one
    continuation only is replaced by that (" tras" by " trash ").
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCUMENTS)
    sample = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(known), "_id")
    sample = written(sample.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_text", "_y"), "labelled")
    n = {r._y: r.n for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon(exceptions=exceptions)
    rate = n[1] / (n[0] + n[1])
    counts = written(learn_counts(sample, "_text", "_y").where("toxic >= 3"), "patterns")
    # the surplus's significance: log of the chance of so many toxic ones among its documents, by the relative entropy bound
    total, share = F.col("toxic") + F.col("clean"), (F.col("toxic") / (F.col("toxic") + F.col("clean")))
    surplus = total * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    kept = counts.where((share > 2 * rate) & (share > 0.6)).withColumn("surplus", surplus)
    tests = 100.0 * max(1, counts.count())
    rows = kept.where(F.col("surplus") > math.log(tests)).select("pattern", "toxic", "clean").collect()
    by = {r.pattern: r for r in rows}
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.pattern.strip()), r.pattern)):
        word = r.pattern.strip()
        shorter = [by[s] for n_ in range(1, len(word) + 1) if (s := " " + word[:n_]) in weights]
        if not any(s.toxic / (s.toxic + s.clean) >= r.toxic / (r.toxic + r.clean) - 0.02 for s in shorter):
            weights[r.pattern] = math.log((r.toxic + 0.5) / (n[1] + 1)) - math.log((r.clean + 0.5) / (n[0] + 1))
    ordered = sorted(by)
    for p in list(weights):
        longer = ordered[bisect_left(ordered, p) : bisect_left(ordered, p + "\U0010ffff")]
        longest = max((q for q in longer if by[q].toxic >= 0.95 * by[p].toxic), key=len)
        weights[longest] = weights.pop(p)
    lexicon = Lexicon(weights, exceptions)
    return _calibrated(lexicon, sample)


def _calibrated(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """Coefficients by Newton steps on (total, words, label), of which there are at most FIT_DOCUMENTS rows."""
    got = match(sample, lexicon, text="_text").select("toxic_weight", "n_words", "_y").toPandas()
    x = np.array([features_of(t, w) for t, w in zip(got.toxic_weight, got.n_words, strict=True)] or np.zeros((0, 2)))
    x, y = np.column_stack([np.ones(len(x)), x]), got._y.to_numpy(float)
    b = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        b -= np.linalg.solve(h, x.T @ (p - y) + np.array([1e-3, 0.1, 0.1]) * b)
    return Lexicon(lexicon.weights, lexicon.exceptions, *map(float, b))


def match(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with toxic_weight (sum of weights matched), n_matches and n_words (folded words)."""
    extra = [T.StructField("toxic_weight", T.DoubleType(), False), T.StructField("n_matches", T.LongType(), False), T.StructField("n_words", T.LongType(), False)]
    fields = [f for f in docs.schema.fields if f.name not in {e.name for e in extra}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            got = [(*weighted_matches(f := fold(t or ""), automaton), max(f.count(" ") - 1, 0)) for t in batch.column(text).to_pylist()]
            more = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *more], [f.name for f in fields + extra])

    return docs.select(*[f.name for f in fields]).mapInArrow(run, T.StructType(fields + extra))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """match() with score, from 0 to 1."""
    plain = F.log1p("toxic_weight")
    dense = F.log1p(100.0 * F.col("toxic_weight") / F.greatest(F.col("n_words"), F.lit(1)))
    z = F.lit(lexicon.bias) + F.lit(lexicon.plain) * plain + F.lit(lexicon.by_length) * dense
    return match(docs, lexicon, text).withColumn("score", 1 / (1 + F.exp(-z)))
