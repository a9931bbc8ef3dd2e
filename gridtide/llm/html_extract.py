"""HTML extraction by wrapper induction over the pages of a host.

Each page's DOM is reduced to the tree of its block elements, siblings of one kind
(tag, classes, id) merged into one node, so that a list of any length is one slot. Simple
tree matching aligns that tree with the host's commonest one. Over all pages of the
host, aligned nodes with (nearly) constant text, or made of links, are the template;
those whose text varies are the content, inside an article or main element and outside. Where
list items or paragraphs are one slot, those that (nearly) all pages repeat are template by themselves.
Pages count once by the text of their article or main element (of all slots, without one), so copies
of a page don't make its text constant. Where a host has too few pages to tell, an article or main
element bounds the content. Elements that by their kind aren't
main text (menus, footers, forms, adverts, comments and so on) are template everywhere.

Trees are aligned down to MOST_DEPTH levels; text that stands deeper belongs to the node of that level.
Levels of very many different kinds (PAIRED pairs) are aligned by equal kinds alone.

A null or empty page gives an empty text, and a null url is a host of its own. Markup
that isn't closed or nests wrongly is repaired as browsers do for paragraphs and lists, and odd declarations
are comments, as they are there. Pages may nest elements to any depth.
Every row is kept, repeated ones too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.spaces import written
from gridtide.llm.url_filter import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea dialog menu".split())
BLOCKS = frozenset("html body article main section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr fieldset details summary center".split()) | DROPPED
#: What an opening tag closes first, if it is open (up to a container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table article main section div body html blockquote".split())
_ROLE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|masthead|topbar|(?:site|page)[-_]?(?:header|footer)|header|footer|"
    r"side-?bar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommended|comments?|comment-?list|disqus|respond|repl(?:y|ies)|login|signup|search|pagination|pager|skip-?link)(?:$|[^a-z])"
)
_LANDMARK = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

#: A slot is template from so many distinct pages of a host on, if so large a share has the same text, or is links.
LEAST_PAGES, CONSTANT_SHARE, LINK_SHARE = 4, 0.8, 0.6
#: Levels of a tree that are aligned, and pairs of a level's nodes from which on only nodes of one kind are aligned.
MOST_DEPTH, PAIRED = 64, 1_000_000
#: Hosts with so large a share of all pages (fewer than its inverse, then) are dealt to so many parts.
HOT_SHARE, HOT_PARTS = 0.002, 128


class Node:
    __slots__ = ("tag", "kind", "children", "dropped", "root", "inside", "in_article")

    def __init__(self, tag: str, kind: str, dropped: bool, root: bool, above: Node | None = None):
        self.tag, self.kind, self.dropped, self.root = tag, kind, dropped, root
        self.inside = root or (above is not None and above.inside)
        self.in_article = (root and tag == "article") or (above is not None and above.in_article)
        self.children: list = []  # nodes, and (text, in a link)


def kind_of(tag: str, names: list[str]) -> str:
    """What tells elements of one tag apart: classes and id without digits and signs that trees are written with; long ones by their hash."""
    kind = re.sub(r"[\d(),/]+", "", ".".join([tag, *names]))
    return kind if len(kind) <= 60 else f"{tag}.{xxhash.xxh64_hexdigest(kind)}"


_COMMENT_END = re.compile(r"--!?>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("html", "html", False, False)
        self.stack, self.open, self.links = [self.top], Counter(), 0
        self.last_gt = -1

    def read(self, html: str) -> Node:
        self.last_gt = html.rfind(">")
        self.feed(html)
        self.last_gt = self.rawdata.rfind(">")
        self.close()
        return self.top

    # what isn't closed goes on to the end, and each declaration is a comment but <!-- --> up to the next >
    def parse_comment(self, i, report=1):
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        m = _COMMENT_END.search(self.rawdata, i + 4)
        return m.end() if m else len(self.rawdata)

    def _up_to_gt(self, i, report=1):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    parse_html_declaration = parse_pi = parse_marked_section = parse_bogus_comment = _up_to_gt

    def parse_starttag(self, i):
        return super().parse_starttag(i) if i < self.last_gt else len(self.rawdata)

    def parse_endtag(self, i):
        return super().parse_endtag(i) if i < self.last_gt else len(self.rawdata)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.stack[-1].children.append((" ", False))
            return
        if tag == "a":
            self.links += 1
            return
        if tag not in BLOCKS:
            return
        if tag == "p" or (tag in BLOCKS and tag not in DROPPED):  # a block ends an open paragraph
            self._close({"p"}, CONTAINERS)
        if tag in CLOSES:
            self._close(CLOSES[tag], CONTAINERS)
        if tag == "body" or tag == "html":
            return
        a = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop", "hidden", "aria-hidden")}
        name = f"{a.get('class', '')} {a.get('id', '')}".lower()
        above = self.stack[-1]
        root = tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody"
        dropped = tag in DROPPED or (tag == "header" and not above.inside) or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in _LANDMARK or (tag not in ("article", "main") and bool(name.strip()) and bool(_ROLE.search(name)))
        if tag == "article" and above.in_article and _ROLE.search(name):
            dropped = True  # a comment inside the article
        node = Node(tag, kind_of(tag, name.split()), dropped, root and not dropped, above)
        above.children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def _cut(self, i: int) -> None:
        for n in self.stack[i:]:
            self.open[n.tag] -= 1
        del self.stack[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS and tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tags, stop):
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in stop:
                return

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS and self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    self._cut(i)
                    self.links = 0
                    return

    def handle_data(self, data):
        self.stack[-1].children.append((data, self.links > 0))


def parse(html: str) -> Node:
    return _Builder().read(html)


def _own_text(node: Node) -> str:
    return " ".join(t for c in node.children if not isinstance(c, Node) and (t := c[0].strip()))


def _step(path: str, node: Node, depth: int) -> str:
    """The path of a node below the one of a path."""
    return f"{path}/{node.kind}" if depth < MOST_DEPTH else path


def slots_of(top: Node) -> tuple[str, dict[str, tuple[list[str], int, int, bool]]]:
    """The page's tree of kinds as a string, and by path: texts of its nodes, characters, those in links, whether inside the main element."""
    texts: dict[str, list] = {}
    tree: dict = {}
    todo = [(top, "", tree, 0)]
    while todo:
        node, above, branch, depth = todo.pop()
        path, own = _step(above, node, depth), branch
        if depth < MOST_DEPTH:
            own = branch.setdefault(node.kind, {})
        slot = texts.setdefault(path, [[], 0, 0, node.inside])
        later = []
        for c in node.children:
            if isinstance(c, Node):
                if not c.dropped:
                    later.append((c, path, own, depth + 1))
            elif t := c[0].strip():
                slot[1] += len(t)
                slot[2] += len(t) * c[1]
        if t := _own_text(node):
            slot[0].append(t)
        todo.extend(reversed(later))
    return _written(tree), {p: tuple(slot) for p, slot in texts.items()}


def _written(tree: dict) -> str:
    return ",".join(f"{k}({_written(v)})" if v else k for k, v in tree.items())


@lru_cache(50_000)
def _read(shape: str) -> tuple:
    """((kind, children), ...) of a written tree."""
    stack: list[list] = [[]]
    for m in re.finditer(r"([^(),]+)|([()])", shape):
        if m[1]:
            stack[-1].append([m[1], []])
        elif m[2] == "(":
            stack.append(stack[-1][-1][1])
        else:
            stack.pop()
    freeze = lambda nodes: tuple((k, freeze(c)) for k, c in nodes)
    return freeze(stack[0])


@lru_cache(200_000)
def _tree_match(a: tuple, b: tuple) -> tuple[int, tuple]:
    """Simple tree matching of two nodes: the most nodes that match in order, and which of a's children go with which of b's."""
    if a[0].split(".")[0] != b[0].split(".")[0]:
        return 0, ()
    x, y = a[1], b[1]
    if len(x) * len(y) > PAIRED:
        pairs = _same_kinds([k for k, _ in x], [k for k, _ in y])
        return 1 + sum(_tree_match(x[i], y[j])[0] for i, j in pairs), tuple(pairs)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            w = _tree_match(x[i - 1], y[j - 1])[0]
            w += bool(w) and x[i - 1][0] == y[j - 1][0]  # the same kind goes before the same tag
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[len(x)][len(y)], tuple(pairs[::-1])


def _same_kinds(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The most pairs of equal kinds, each of which is once in a level, in the order of both: a longest rising sequence."""
    place = {k: j for j, k in enumerate(y)}
    pairs = [(i, place[k]) for i, k in enumerate(x) if k in place]
    ends: list[int] = []  # the least place at which a sequence of each length ends, and which pair that is
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


@lru_cache(50_000)
def aligned(shape: str, reference: str) -> dict[str, str]:
    """The reference's path for each path of a page's tree that tree matching aligns."""
    found: dict[str, str] = {}
    if not shape or not reference:
        return found
    todo = [(_read(shape)[0], _read(reference)[0], "", "")]
    while todo:
        a, b, pa, pb = todo.pop()
        size, pairs = _tree_match(a, b)
        if size:
            pa, pb = f"{pa}/{a[0]}", f"{pb}/{b[0]}"
            found[pa] = pb
            todo += [(a[1][i], b[1][j], pa, pb) for i, j in pairs]
    return found


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Wrapper(NamedTuple):
    """A host's: the commonest tree, its paths that are template and those that are content, and (path, hash) of texts that are template in other slots."""

    reference: str = ""
    template: frozenset[str] = frozenset()
    content: frozenset[str] = frozenset()
    repeated: frozenset[tuple[str, int]] = frozenset()


def _blocks(node: Node, path: str, to: dict[str, str], wrapper: Wrapper, need_root: bool, out: list[str]) -> None:
    """Appends the blocks of the content, in page order; to: the reference's paths of the page's."""
    stack: list = [("node", node, path, 0)]
    run: list[str] = []
    mixed = {p for p, _ in wrapper.repeated}

    def flush():
        if run:
            if t := " ".join("".join(run).split()):
                out.append(t)
            run.clear()

    while stack:
        what, x, p, depth = stack.pop()
        if what == "text":
            run.append(x)
        elif what == "end":
            flush()
        elif not x.dropped:
            flush()
            own = _step(p, x, depth)
            at = to.get(own, own)
            told = at not in wrapper.template and (x.inside or not need_root or at in wrapper.content)
            told = told and not (at in mixed and (at, _text_hash(_own_text(x))) in wrapper.repeated)
            stack.append(("end", None, None, None))
            for c in reversed(x.children):
                if isinstance(c, Node):
                    stack.append(("node", c, own, depth + 1))
                elif told:
                    stack.append(("text", c[0], None, None))
        else:
            flush()
    flush()


def _has_root(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.root:
            return True
        todo += [c for c in n.children if isinstance(c, Node) and not c.dropped]
    return False


def main_text(html: str, wrapper: Wrapper = Wrapper()) -> str:
    """Blocks joined by newlines."""
    if not html:
        return ""
    top = parse(html)
    to = aligned(slots_of(top)[0], wrapper.reference) if wrapper.template or wrapper.content or wrapper.repeated else {}
    out: list[str] = []
    _blocks(top, "", to, wrapper, _has_root(top), out)
    return "\n".join(out)


_FEATURES = "host string, page long, shape string, slots array<struct<path:string,text:long,chars:long,links:long,inside:boolean,whole:boolean>>"


def _features(html: str) -> tuple[int, str, list[dict]]:
    """Hash of the text that tells a page from others, tree, and texts: of whole slots, and of each node of slots that have several."""
    shape, slots = slots_of(parse(html))
    main = [(p, t) for p, (t, n, _, inside) in slots.items() if n and inside] or [(p, t) for p, (t, n, _, _) in slots.items() if n]
    found = []
    for p, (texts, n, k, inside) in slots.items():
        if n:
            found.append({"path": p, "text": _text_hash(" ".join(texts)), "chars": n, "links": k, "inside": inside, "whole": True})
            if len(texts) > 1:
                found += [{"path": p, "text": h, "chars": 0, "links": 0, "inside": inside, "whole": False} for h in {*map(_text_hash, texts)}]
            else:
                found.append(found[-1] | {"whole": False})
    return _text_hash(repr(main)), shape, found


def _hot(hosts: DataFrame) -> list[str]:
    """Hosts (of host, pages) with HOT_SHARE of all pages or more."""
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    return [r.host for r in hosts.where(F.col("pages") >= F.lit(HOT_SHARE * total)).select("host").collect()]


def _parts(host: str, hot: list[str]) -> Column:
    """Numbers of the parts to which a host's rows are dealt."""
    return F.when(F.col(host).isin(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))


def _part(host: str, hot: list[str], *by: str) -> Column:
    return F.when(F.col(host).isin(hot), F.pmod(F.xxhash64(*by), F.lit(HOT_PARTS)).cast("int")).otherwise(0)


def induce(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, pages (how many), reference (its commonest tree), template and content (arrays of the reference's paths), repeated (array of path, text)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(host, *_features(page or "")) for host, page in zip(pdf["_host"], pdf["_html"], strict=True)], columns=["host", "page", "shape", "slots"])

    own = pages.select(host_of(F.col(url)).alias("_host"), F.col(html).alias("_html")).mapInPandas(features, _FEATURES)
    own = written(own, "slots")  # hashes of texts, far smaller than the pages; read three times
    common = own.groupBy("host", "shape").agg(F.count("*").alias("n"))
    reference = written(common.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by("shape", F.struct("n", "shape")).alias("reference")), "references")
    hot = _hot(reference)

    @F.pandas_udf("map<string,string>")
    def align(shape: pd.Series, to: pd.Series) -> pd.Series:
        return pd.Series([aligned(a, b) for a, b in zip(shape, to, strict=True)])

    pairs = common.select("host", "shape").join(reference.select("host", "reference"), "host").withColumn("to", align("shape", "reference"))
    pairs = pairs.withColumn("part", F.explode(_parts("host", hot)))
    # texts of each slot, each distinct page once, counted before anything is joined
    each = own.select("host", "shape", "page", F.explode("slots").alias("s")).select("host", "shape", "page", "s.*")
    once = each.groupBy("host", "shape", "path", "whole", "text", "page").agg(F.max("chars").alias("chars"), F.max("links").alias("links"), F.max("inside").alias("inside"))
    sums = [F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("inside").alias("inside")]
    texts = once.groupBy("host", "shape", "path", "whole", "text").agg(F.count("*").alias("n"), *sums).withColumn("part", _part("host", hot, "text"))
    slots = texts.join(pairs, ["host", "shape", "part"]).withColumn("path", F.coalesce(F.element_at("to", F.col("path")), F.col("path")))
    by_text = written(slots.groupBy("host", "path", "whole", "text").agg(F.sum("n").alias("n"), *sums), "texts")
    by_slot = by_text.where("whole").groupBy("host", "path").agg(F.sum("n").alias("n"), F.max("n").alias("most"), *sums)
    enough = F.col("n") >= LEAST_PAGES
    # a heading of an article may be a link
    linked = (F.col("links") >= LINK_SHARE * F.col("chars")) & (~F.col("inside") | (enough & ~F.regexp_extract("path", "([^/.]*)[^/]*$", 1).rlike("^h[1-6]$")))
    by_slot = written(by_slot.withColumn("is_template", (enough & (F.col("most") >= CONSTANT_SHARE * F.col("n"))) | linked), "by_slot")
    # a text on CONSTANT_SHARE of LEAST_PAGES pages or more has so many itself
    often = by_text.where(~F.col("whole") & (F.col("n") >= CONSTANT_SHARE * LEAST_PAGES)).select("host", "path", "text", F.col("n").alias("m"))
    often = often.join(by_slot.where(enough & ~F.col("is_template")).select("host", "path", "n"), ["host", "path"]).where(F.col("m") >= CONSTANT_SHARE * F.col("n"))
    repeated = often.groupBy("host").agg(F.collect_set(F.struct("path", "text")).alias("repeated"))  # no more than a page has texts, by 1 / CONSTANT_SHARE
    told = by_slot.groupBy("host").agg(F.collect_set(F.when(F.col("is_template"), F.col("path"))).alias("template"), F.collect_set(F.when(enough & ~F.col("is_template"), F.col("path"))).alias("content"))  # as many as a tree has paths
    return reference.join(told, "host", "left").join(repeated, "host", "left")


def extract(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """pages with the main text of each."""
    fields = [f for f in pages.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(text, T.StringType(), False)])
    wrappers = written(induce(pages, html, url), "wrappers")
    hot = _hot(wrappers)
    # a hot host's pages are dealt out by their own hash, and its wrapper to all those parts
    wrappers = wrappers.select(F.col("host").alias("_host"), F.struct("reference", "template", "content", "repeated").alias("_wrapper")).withColumn("_part", F.explode(_parts("_host", hot)))

    def wrapper_of(row: dict | None) -> Wrapper:
        if not row:
            return Wrapper()
        return Wrapper(row["reference"] or "", frozenset(row["template"] or ()), frozenset(row["content"] or ()), frozenset((r["path"], r["text"]) for r in row["repeated"] or ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (html, "_wrapper")]
            got = [main_text(h or "", wrapper_of(w)) for h, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(got, pa.string())], [*[f.name for f in fields], text])

    named = pages.select(*[f.name for f in fields]).withColumn("_host", host_of(F.col(url))).withColumn("_part", _part("_host", hot, *[f.name for f in fields]))
    return named.join(wrappers, ["_host", "_part"], "left").select(*[f.name for f in fields], "_wrapper").mapInArrow(run, schema)
