"""Operators on pairs and the pipeline, against brute force."""

import itertools
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridtide.llm import toxicity
from gridtide.llm.op5 import default_model
from gridtide.llm.op10 import lexicon_of
from gridtide.llm import line_dedup, ngram_join, op6
from gridtide.llm.components import components
from gridtide.llm import decontaminate
from gridtide.llm.decontaminate import find_contamination
from gridtide.llm.line_dedup import dedup_lines, edits_allowed, within_edits
from gridtide.llm.ngram_join import similar_components

DATA = "/root/testdata/sf0.001"


def words(r, n):
    return ["".join(r.choice("abcdeiostn") for _ in range(r.randint(2, 7))) for _ in range(n)]


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({n for p in pairs for n in p})
    assert got == groups(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def changed(r, s, k):
    s = list(s)
    for _ in range(k):
        p, how = r.randint(0, len(s)), r.random()
        if how < 0.4:
            s.insert(p, r.choice("abü 😀"))
        elif how < 0.7 and s:
            del s[min(p, len(s) - 1)]
        elif s:
            s[min(p, len(s) - 1)] = r.choice("abz ")
    return "".join(s)


def test_edit_distance():
    r = random.Random(3)
    left = ["".join(r.choice("abé") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    right = [changed(r, a, r.randint(0, 5)) for a in left]
    most = np.array([r.randint(0, 4) for _ in left])
    assert within_edits(left, right, most).tolist() == [distance(a, b) <= m for a, b, m in zip(left, right, most, strict=True)]
    assert within_edits([], [], np.zeros(0)).tolist() == []


def test_sketches_bound_edits():
    r = random.Random(4)
    lines = [" ".join(words(r, 15)) for _ in range(300)]
    for k in (1, 2):
        other = [changed(r, x, k) for x in lines]
        bits = [np.bitwise_count((a ^ b).view(np.uint64)) for a, b in zip(line_dedup.sketches([*lines, ""]), line_dedup.sketches([*other, ""]), strict=True)]
        assert (bits[0] + bits[1]).max() <= 3 * k
        assert bits[2].max() <= 2 * k


def brute_lines(docs, edits=line_dedup.EDITS):
    """id, text, lines that went because of an equal one, and because of a near one, for each row."""
    usable = lambda x: len(x) >= line_dedup.LEAST_CHARS and x.strip(" ")
    places = sorted({(i, k, t): x for i, t in docs if t is not None for k, x in enumerate(t.split("\n")) if usable(x)}.items(), key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[0][1], p[0][2]))
    lines = sorted({x for _, x in places})
    allowed = lambda a, b: sum(min(len(a), len(b)) >= e for e in edits)
    pairs = [(a, b) for a, b in itertools.combinations(lines, 2) if abs(len(a) - len(b)) <= (m := allowed(a, b)) and distance(a, b) <= m]
    group = groups(pairs, lines)
    first, gone = {}, {}
    for place, x in places:
        if group[x] in first:
            gone[place] = x == first[group[x]]
        first.setdefault(group[x], x)
    out = []
    for i, t in docs:
        own = [gone.get((i, k, t)) for k in range(len(t.split("\n")))] if t is not None else []
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if own[k] is None), own.count(True), own.count(False)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("edits", [line_dedup.EDITS, (12, 24, 40, 55)])
def test_line_dedup(spark, edits):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 80))) for _ in range(40)]
    docs = [(i, "\n".join(changed(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 3, 4])) if r.random() < 0.9 else r.choice(["", " " * 30, "short"]) for _ in range(r.randint(1, 5)))) for i in range(90)]
    docs += [(500, None), (501, ""), (502, base[0] * 200), (503, base[0] * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("line", "node", "copy", "n_near", "component")})
    out = dedup_lines(df, edits=edits).collect()
    assert sorted(((x.doc_id, x.text, x.n_exact, x.n_near) for x in out), key=repr) == brute_lines(docs, edits)
    assert sum(x.n_near for x in out) > 20
    assert dedup_lines(df.limit(0), edits=edits).count() == 0


def test_repeated_rows_are_one_document(spark):
    line = "the same line of more than enough characters"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line + "!"), (None, None)], "doc_id long, text string")
    assert sorted(((x.doc_id, x.text) for x in dedup_lines(df).collect()), key=repr) == sorted([(None, line + "!"), (None, None), (1, ""), (1, ""), (2, "")], key=repr)


def test_short_lines(spark):
    """Equal ones go, whatever their length; one edit apart they stay, and so do blank ones."""
    df = spark.createDataFrame([(1, "x\nShare\n\t\n\nThanks a lot, all of you"), (2, "Share\nshare\n\t\n\nx\nx \nThanks a lot, all of you"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in dedup_lines(df).collect()}
    assert got == {1: ("x\nShare\n\t\n\nThanks a lot, all of you", 0, 0), 2: ("share\n\t\n\nx ", 3, 0), 3: ("", 1, 0)}


# ---- op6


def test_contamination(spark):
    r = random.Random(6)
    items = [(i, " ".join(words(r, n))) for i, n in enumerate([30, 12, 10, 4, 1, 15])] + [(6, None), (7, ""), (2, " ".join(words(r, 11)))]
    texts = []
    for _ in range(120):
        t = words(r, r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 5))
            p = r.randint(0, len(t))
            t[p:p] = w[a : a + r.randint(1, 20)]
        texts.append(" ".join(t).replace("a", r.choice(["a", "A"])))
    docs = list(enumerate([*texts, None, "", texts[0], "x " * 20_000]))
    docs.append(docs[5])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("term", "copy", "start", "item_id")})
    got = sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    windows = {}
    for i, t in items:
        w = (t or "").lower().split()
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in docs:
        w = (t or "").lower().split()
        hit, found = set(), set()
        for p in range(len(w)):
            for size in {len(x) for x in windows}:
                if p + size <= len(w) and (own := windows.get(tuple(w[p : p + size]))):
                    hit.update(range(p, p + size))
                    found |= own
        want.append((i, len(w), len(hit), sorted(found)))
    assert got == sorted(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(df, none).where("n_hit > 0").count() == 0
    assert find_contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_parts_of_the_vocabulary(spark, monkeypatch):
    r = random.Random(7)
    items = spark.createDataFrame([(i, " ".join(words(r, 12))) for i in range(12)], "item_id long, text string")
    docs = items.select((F.col("item_id") * 2).alias("doc_id"), "text")
    whole = find_contamination(docs, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "VOCABULARY", 20)
    assert find_contamination(docs, items).orderBy("doc_id").collect() == whole


def brute_near(docs, items, slack=2):
    """Items that each text comes near: the two rarest terms within the slack, and most terms of the window about there."""
    texts = {t: (t or "").split() for _, t in docs}
    n = {}
    for _, t in docs:
        for w in texts[t]:
            n[w] = n.get(w, 0) + 1
    out = {}
    for t, w in texts.items():
        for i, x in items:
            x = x.split()
            for k in range(max(1, len(x) - 9)):
                win = x[k : k + 10]
                rare = sorted((n[v], j, v) for j, v in enumerate(win) if v in n)[:2]
                for p in range(len(w)):
                    begin = p - rare[0][1] if rare and w[p] == rare[0][2] else None
                    if begin is None or begin < -slack or (len(rare) > 1 and not any(abs(q - p - rare[1][1] + rare[0][1]) <= slack and w[q] == rare[1][2] for q in range(len(w)))):
                        continue
                    begin = max(begin, 0)
                    own = set(w[max(0, begin - slack) : begin + len(win) + slack])
                    if w[begin : begin + len(win)] == win:
                        out.setdefault(t, {})[i] = True
                    elif len(own & set(win)) >= 0.8 * len(set(win)):
                        out.setdefault(t, {}).setdefault(i, False)
    return sorted(((i, sorted(str(k) for k, e in out.get(t, {}).items() if e), sum(not e for e in out.get(t, {}).values())) for i, t in docs), key=repr)


def test_proximity(spark):
    r = random.Random(17)
    items = [(i, " ".join(words(r, 14))) for i in range(8)] + [(8, "one two"), (9, "red red red blue red red red red red red blue")]
    docs = []
    for i in range(150):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(w) + 1)
            w[p : p + r.randint(0, 1)] = words(r, r.randint(0, 2))
        docs.append((i if i % 10 else None, " ".join(words(r, r.randint(0, 6)) + w + words(r, r.randint(0, 6)))))
    docs += docs[:5]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_near(docs, items)
    assert sorted(((x.doc_id, x["items"], x.n_near) for x in got), key=repr) == want
    assert sum(n for *_, n in want) > 20


def test_huge_items_and_null_ids(spark):
    r = random.Random(18)
    whole = words(r, 30_000)
    items = spark.createDataFrame([(1, " ".join(whole)), (None, " ".join(whole[100:115]))], "item_id long, text string")
    docs = spark.createDataFrame([(None, " ".join(whole[20_000:20_020])), (None, None), (5, " ".join(whole[100:112])), (5, "nothing")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in find_contamination(docs, items).collect()), key=repr)
    assert got == sorted([(None, 20, 20, ["1"]), (None, 0, 0, []), (5, 12, 12, ["1"]), (5, 1, 0, [])], key=repr)


def test_op6_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(op6.SQL["op6_decontaminate"])
    got = op6.op6_decontaminate(spark, DATA).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_op6_has_the_columns_of_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(op6.SQL["op6_decontaminate"])
    got = op6.op6_decontaminate(spark, DATA)
    types = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [(n, types[t]) for n, t in got.dtypes] == [(n, str(t)) for n, t in zip(want.columns, want.types, strict=True)]


# ---- op9


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "t", "frequent", "combined"), [(3, Fraction(9, 10), 2, 40), (5, Fraction(4, 5), 2, 40), (3, Fraction(9, 10), 2, 2), (2, Fraction(1, 2), 32, 40)])
def test_ngram_join(spark, monkeypatch, k, t, frequent, combined):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "COMBINED", combined)
    r = random.Random(8)
    bases = [words(r, n) for n in (3, 9, 12, 20, 30, 45, 80, 81)]
    shared = words(r, 15)
    docs = []
    for i in range(160):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            p = r.randrange(len(w))
            w[p : p + r.randint(0, 1)] = words(r, r.randint(0, 2))
        docs.append((i, " ".join((shared if r.random() < 0.3 else []) + w)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, docs[3][1].upper()), (3, docs[3][1]), (904, " ".join(words(r, 9000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("node", "n", "key", "component")})
    sets = {i: shingles(x, k) for i, x in docs}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= t]
    want = groups(linked, sorted(sets))
    got = similar_components(df, k, t).collect()
    assert len(got) == len(docs)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(sets)


def test_ngram_join_without_rows(spark):
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = similar_components(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()
    assert row.component_id is None


def test_null_ids_link(spark):
    r = random.Random(10)
    t, other = words(r, 60), words(r, 60)
    changed = [" ".join([*x[:30], "new", *x[31:]]) for x in (t, other)]
    docs = [(None, " ".join(t)), (None, changed[0]), (None, " ".join(t)), (7, " ".join(other)), (None, changed[1]), (8, None), (None, None), (None, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = similar_components(df, 5, Fraction(4, 5)).collect()
    assert sorted((x.n_shingles, x.component_id) for x in got if x.doc_id is not None) == [(0, 8), (56, 7)]
    assert [x.component_id for x in got if x.doc_id is None] == [None] * 6
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, df, DATA).collect()]
    assert {x for _, x in kept} - {" ".join(t), changed[0]} == {" ".join(other), None, "alone"}
    assert len({x for _, x in kept} & {" ".join(t), changed[0]}) == 1


def test_ids_of_any_type(spark):
    r = random.Random(19)
    t = words(r, 60)
    docs = [("d", " ".join(t)), ("b", " ".join([*t[:30], "new", *t[31:]])), ("c", " ".join(words(r, 20))), (None, " ".join(t))]
    got = similar_components(spark.createDataFrame(docs, "doc_id string, text string"), 5, Fraction(4, 5)).collect()
    assert {x.doc_id: x.component_id for x in got} == {"d": "b", "b": "b", "c": "c", None: None}


@pytest.mark.parametrize(("share", "front", "most"), [(0.9, 8, 1.2), (0.3, 8, 9), (0.5, 1, 20)])
def test_pairs_are_made_once(spark, monkeypatch, share, front, most):
    """Pairs in many lists are made in their first one, and none is lost."""
    monkeypatch.setattr(ngram_join, "FRONT", front)
    r = random.Random(20)
    t = Fraction(9, 10)
    at = {}
    for node in range(40):
        for position, key in enumerate(k for k in range(60) if r.random() < share):
            at[node, key * 7919 % 101] = position
    n = {node: r.randint(280, 320) for node in range(40)}
    held = spark.createDataFrame([(key, node, n[node], p, node // 2) for (node, key), p in at.items()], "key long, node long, n int, position int, component long")
    nodes = spark.createDataFrame([(node, n[node], [0] * ngram_join.SKETCH) for node in n], "node long, n long, sketch array<long>")
    got = [(x.a, x.b) for x in ngram_join.open_pairs(ngram_join.lists_with_fronts(held, nodes), t).collect()]
    want = [
        (a, b)
        for (a, key), p in at.items()
        for b in range(a + 1, 40)
        if a // 2 != b // 2 and (b, key) in at and Fraction(least := min(n[a] - p, n[b] - at[b, key]), n[a] + n[b] - least) >= t
    ]
    assert set(got) == set(want)
    assert len(got) <= most * len(set(want))
    assert len(got) < len(want)


def test_frequent_tokens(spark, monkeypatch):
    """Every token of every distinct set counts, however the sets are dealt to tasks and tokens to parts."""
    monkeypatch.setattr(ngram_join, "COUNTED", 300)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    r = random.Random(21)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts = [*{frozenset(shingles(t, 2)): t for t in texts if t}.values()]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(5)
    kept = []

    class Scratch:
        def written(self, df, name):
            kept.extend(x.token for x in df.collect())
            return df

    ngram_join.frequent_tokens(df, 2, Scratch(), 1000)
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens, n = np.unique(ngram_join.shingle_rows(data, offsets, 2)[1], return_counts=True)
    assert sorted(kept) == sorted(tokens[n >= 3].view(np.int64).tolist())
    assert kept and (n < 3).any()


# ---- the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert counts == sorted(counts, reverse=True)
    assert counts[4] == counts[5]
    assert docs.where("NOT restored").count() == 0
    # what is left links with nothing, has no benchmark passage and no repeated line
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: s for i, x in texts.items() if (s := shingles(x, 5))}
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2))
    lines = [x for t in texts.values() for x in t.split("\n") if len(x) >= line_dedup.LEAST_CHARS and x.strip()]
    assert len(lines) == len(set(lines))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of made-up documents, labels and benchmark items: toxic ones, copies, repeated lines, passages, nulls, repeated rows and columns with clashing names."""
    r = random.Random(21)
    items = [(i, " ".join(words(r, 16))) for i in range(4)]
    lines = [" ".join(words(r, 12)) for _ in range(6)]
    rows = []
    for i in range(150):
        w = words(r, 40)
        if i % 5 == 0:
            w[7:7] = ["you", "scumbag"]
        if i % 7 == 0:
            w[20:20] = r.choice(items)[1].split()[2 : 2 + r.randint(8, 12)]
        text = " ".join(w) + (f"\n{r.choice(lines)}" if i % 3 == 0 else "")
        rows.append((i, text))
        if i % 9 == 0:
            rows += [(1000 + i, text), (2000 + i, " ".join(["otherwise", *text.split(" ")[1:]]))]
    rows += [(3000, None), (3001, ""), (3002, " \n "), (None, rows[3][1]), (None, "alone and short"), (None, None), rows[5], (3003, "\n".join(lines)), (3004, "x " * 30_000)]
    folder = str(tmp_path_factory.mktemp("small"))
    docs = spark.createDataFrame([(*x, "en", len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, n_chars long")
    docs = docs.withColumns({c: F.lit("own") for c in ("copy", "node", "line", "component", "least", "score", "n_exact", "_id", "term", "start", "items", "n_hit")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(140)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows_of(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=repr)


def test_pipeline_equals_brute_force(spark, small):
    folder, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    staged = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, folder), name)
        staged[name] = (rows_of(docs), out)
        docs = out
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        assert staged[name][1].columns == columns
        assert {x.score for x in staged[name][1].select("score").distinct().collect()} == {"own"}

    before, out = staged["toxicity"]
    lexicon = lexicon_of(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)

    def toxic(text):
        folded = toxicity.fold(text or "")
        best = {}
        for p, w in lexicon.weights.items():
            for i in range(len(folded)):
                if folded.startswith(p, i):
                    best[i] = max(w, best.get(i, w))
        total, n = sum(best.values()), max(1, len(folded.split()))
        return lexicon.bias + lexicon.plain * np.log1p(total) + lexicon.by_length * np.log1p(100 * total / n) >= 0

    assert rows_of(out) == [x for x in before if not toxic(x[1])]
    assert len(before) > len(rows_of(out)) > 0.7 * len(before)

    before, out = staged["line_dedup"]
    want = [(i, t) for i, t, exact, near in brute_lines(before) if not (exact + near and not t.strip(" \n"))]
    assert rows_of(out) == sorted(want, key=repr)
    assert all(x.n_chars == len(x.text or "") for x in out.collect())

    before, out = staged["near_duplicates"]
    texts = sorted({(i is None, i or 0, t or "") for i, t in before}, key=lambda k: (k[0], k[1]))
    sets = {k: shingles(k[2], 5) for k in texts}
    linked = [(a, b) for a, b in itertools.combinations(texts, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = groups(linked, texts)
    kept = {k for k in texts if k == group[k] or not sets[k]}
    assert all(not a[0] and not b[0] for a, b in linked)  # no links among null ids alone, which hashes order
    assert rows_of(out) == [x for x in before if (x[0] is None, x[0] or 0, x[1] or "") in kept]
    assert len(linked) > 3

    before, out = staged["decontamination"]
    passages = {tuple(w[k : k + 10]) for _, t in items for w in [t.split()] for k in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[k : k + 10]) in passages for w in [(t or "").lower().split()] for k in range(len(w)))
    assert rows_of(out) == [x for x in before if not hit(x[1])]
    assert len(before) > len(rows_of(out))

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for x in staged["sentencepiece"][1].collect():
        assert x.ids == sp.encode(x.text or "")
        assert x.n_tokens == len(x.ids)
        assert x.restored == (sp.decode(x.ids) == (x.text or ""))


def test_pipeline_without_rows(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small[0]).count() == 0


def test_recall_of_near_duplicates(spark):
    """Against brute force over the stage's own input: every pair of documents with a Jaccard index of 0.8 or more."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), "stage")
    sets = {r.doc_id: s for r in docs.collect() if (s := shingles(r.text, 5))}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = groups(linked, sorted(sets))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()}
    assert {i for i in sets if i in kept} == {i for i, m in least.items() if i == m}


def test_large_sets(spark):
    """Sets whose sketches have more numbers than small ones' are compared by these, also with sets of other sizes."""
    r = random.Random(9)
    docs = []
    for n in (900, 1010, 1040, 2045, 4090, 4300, 9000):
        t = [f"w{r.randrange(3000)}" for _ in range(n)]
        docs += [t, [*t[: n // 2], "x", *t[n // 2 :], *["y"] * (n // 50)], [w if r.random() > 0.03 else "z" for w in t], t[: n // 2]]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in docs)}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = similar_components(spark.createDataFrame(docs, "doc_id long, text string"), k=3, threshold=Fraction(9, 10))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == {i: (len(s), least[i]) for i, s in sets.items()}
    assert any(i != m for i, m in least.items())
