"""License scans by a positional index of rare licence words, in DataFrame expressions only.

Each template is a line of words with a mandatory key phrase at a fixed place in it.
The index has, for the key phrase's words of highest inverse document frequency over the
whole corpus, the template and the word's place. A file's words are looked up in that index;
each posting gives a place where the template would begin, postings of one template
must agree on it, and there the whole key phrase must stand. The share of
the template's words that stand in their places is the match's score.

Since every key phrase holds its own index words, no place where one stands is missed,
whatever the frequencies are. Everything happens within a row: nothing is shuffled but the counts of
the templates' own words. Null texts count as empty and match nothing. Every row is kept.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: characters other than controls, white space, punctuation and (after lower-casing) A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"  # the one character outside A-Z whose lower case is a to z alone


class Template(NamedTuple):
    label: str
    words: str
    key: str  # the mandatory phrase, within words
    base: bool = False


#: The base phrases, then the texts of common notices.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining a copy"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms with or without modification"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("public-domain", "released into the public domain", "into the public domain"),
    Template("spdx", "spdx license identifier", "spdx license identifier"),
)


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case; no other word can turn into one of plain letters."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\u212b"))), F.lit(f"({WORD})"), F.lit(1))


def document_frequencies(words: DataFrame, column: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows each of the vocabulary's words occurs (as many counts as the vocabulary has words)."""
    found = words.select(F.explode(F.array_intersect(column, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r.w: r.n for r in found.collect()}


def index_of(templates: Sequence[Template], frequency: dict[str, int], n: int, per_template: int = 2) -> list[dict]:
    """Postings: word w stands at place `at` of template t. The key phrase's words of highest inverse document frequency."""
    found = []
    for t, x in enumerate(templates):
        all_words, key = x.words.split(), x.key.split()
        begin = next(i for i in range(len(all_words)) if all_words[i : i + len(key)] == key)
        idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) for w in key}
        best = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))[: min(per_template, len(key))]
        found += [{"w": key[i], "t": t, "at": begin + i} for i in best]
    return found


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_licenses(docs: DataFrame, text: str = "text", matches: str = "matches", templates: Sequence[Template] = TEMPLATES, least_share: float = 0.5) -> DataFrame:
    """docs with n_words and matches: an array of (label, base, start, share), one for each place of each template.

    start counts words from 0 and is where the template begins; share is how much of the
    template stands in place. Matches of base templates are kept as their whole phrase is mandatory, the
    others from least_share on. Rows are as those of docs; columns named like the new ones are replaced.
    """
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    counted = docs.select(words_of(F.col(text)).alias("_words"))
    frequency = document_frequencies(counted, "_words", vocabulary)
    postings = index_of(templates, frequency, docs.count())
    wanted = sorted({p["w"] for p in postings})
    needed = [sum(p["t"] == t for p in postings) for t in range(len(templates))]
    lines = [
        {"label": x.label, "base": x.base, "words": (ws := x.words.split()), "begin": next(i for i in range(len(ws)) if ws[i : i + len(x.key.split())] == x.key.split()), "key": x.key.split(), "needed": needed[t]}
        for t, x in enumerate(templates)
    ]
    index = _constant(postings, "array<struct<w:string,t:int,at:int>>")
    table = _constant(lines, "array<struct<label:string,base:boolean,words:array<string>,begin:int,key:array<string>,needed:int>>")
    vocabulary_column = F.array(*map(F.lit, wanted))

    ws = F.col("_words")
    placed = F.transform(ws, lambda w, i: F.when(F.array_contains(vocabulary_column, w), F.struct(w.alias("w"), i.alias("i"))))
    out = docs.withColumn("_words", words_of(F.col(text)))
    # only rows that hold one of the index's words are looked at word by word
    out = out.withColumn("_hits", F.when(F.arrays_overlap(ws, vocabulary_column), F.filter(placed, lambda h: h.isNotNull())).otherwise(F.lit(None)))
    begins = F.flatten(F.transform("_hits", lambda h: F.transform(F.filter(index, lambda p: p.w == h.w), lambda p: F.struct(p.t.alias("t"), (h.i - p.at).alias("start")))))
    out = out.withColumn("_begins", F.coalesce(begins, F.array().cast("array<struct<t:int,start:int>>")))
    # postings of a template must agree on where it begins: sorted, equal ones stand together, as many as the template has in the index
    out = out.withColumn("_begins", F.sort_array("_begins"))
    b = F.col("_begins")
    agreed = F.filter(b, lambda x, i: (F.coalesce(F.get(b, i + 1) != x, F.lit(True))) & (F.get(b, i - F.get(table, x.t).needed + 1) == x))
    out = out.withColumn("_agreed", agreed)

    def in_place(words: Column, start: Column) -> Column:
        return F.size(F.filter(words, lambda w, j: F.get(ws, start + j) == w))

    def judged(x: Column) -> Column:
        line = F.get(table, x.t)
        return F.struct(
            line.label.alias("label"),
            line.base.alias("base"),
            x.start.cast("long").alias("start"),
            (in_place(line.words, x.start) / F.size(line.words)).alias("share"),
            (in_place(line.key, x.start + line.begin) == F.size(line.key)).alias("key"),
        )

    out = out.withColumn("_judged", F.transform("_agreed", judged))
    good = F.filter("_judged", lambda m: m.key & (m.base | (m.share >= least_share)))
    out = out.withColumn(matches, F.transform(good, lambda m: F.struct(m.label.alias("label"), m.base.alias("base"), m.start.alias("start"), m.share.alias("share"))))
    return out.withColumn("n_words", F.size("_words").cast("long")).drop("_words", "_hits", "_begins", "_agreed", "_judged")
