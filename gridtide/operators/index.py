"""Finding series: path globs, tag expressions, virtual tags, terms and completions; deleting and pruning.

definitions: sid, org, name, interval, tags (map, with `name`), last_update.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.select import _checked as checked


def node_pattern(node: str) -> str:
    """A glob node as a pattern: * and ? and [...] and {a,b} (which may be nested)."""
    out, depth = [], 0
    for c in node:
        if c == "*":
            out.append("[^.]*")
        elif c == "?":
            out.append("[^.]?")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c in "[]":
            out.append(c)
        else:
            out.append(c if c == "-" else re.escape(c))
    return "".join(out)


def glob_filter(pattern: str, name: Column) -> Column:
    """Leaves only. What stands before the first wildcard is a plain prefix, which scans can prune by."""
    whole = r"\.".join(node_pattern(n) for n in _nodes(pattern))
    prefix = re.split(r"[*?\[{]", pattern)[0]
    return name.startswith(prefix) & name.rlike(f"^{whole}$")


def _nodes(pattern: str) -> list[str]:
    """Split at dots outside braces."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "{") - (c == "}")
        if c == "." and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def visible(defs: DataFrame, org: int, public: int | None = None) -> DataFrame:
    """An organisation's series, and public ones whose path it doesn't have itself."""
    own = defs.where(F.col("org") == org)
    if public is None or public == org:
        return own
    shared = defs.where(F.col("org") == public)
    return own.unionByName(shared.join(own.select("name").distinct(), "name", "left_anti").select(*defs.columns))


def find(defs: DataFrame, pattern: str, since: int | None = None) -> DataFrame:
    """path, leaf: paths of the pattern's length, whether series (leaf) or only above series."""
    depth = len(_nodes(pattern))
    if since is not None:
        defs = defs.where(F.col("last_update") >= since)
    parts = F.split("name", r"\.")
    paths = defs.where(F.size(parts) >= depth).select(F.array_join(F.slice(parts, 1, depth), ".").alias("path"), (F.size(parts) == depth).alias("leaf"))
    return paths.where(glob_filter(pattern, F.col("path"))).distinct()


def expand(defs: DataFrame, *patterns: str, leaves_only: bool = False) -> DataFrame:
    """pattern, path."""
    out = None
    for p in patterns:
        found = find(defs, p)
        found = (found.where("leaf") if leaves_only else found).select(F.lit(p).alias("pattern"), "path").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def names(defs: DataFrame) -> DataFrame:
    """All names, once each and in order."""
    return defs.select("name").distinct().orderBy("name")


def select(defs: DataFrame, pattern: str) -> DataFrame:
    """The definitions of the series that a pattern finds; after ;s follow tags that they must have, name;k=v."""
    path, *tags = pattern.split(";")
    found = defs.where(glob_filter(path, F.col("name")))
    for t in tags:
        key, _, value = t.partition("=")
        found = found.where(F.col("tags")[key] == value)
    return found


@dataclass(frozen=True)
class TagExpression:
    """tag, operator (=, !=, =~, !=~, ^=) and value; the tag `__tag` stands for all names of tags."""

    tag: str
    operator: str
    value: str

    @staticmethod
    def of(text: str) -> TagExpression:
        m = re.fullmatch(r"([^=!~^]+)(=|!=|=~|!=~|\^=)(.*)", text, re.S)
        if not m or m[2] in ("=", "!=") and m[3].startswith("~"):
            m = re.fullmatch(r"([^=!~^]+)(!=~|=~|!=|\^=|=)(.*)", text, re.S)
        if not m:
            raise ValueError(f"not a tag expression: {text!r}")
        return TagExpression(m[1], m[2], m[3])

    def needs_value(self) -> bool:
        """Whether a series must have some value of the tag to pass."""
        if self.operator in ("=", "^="):
            return self.value != ""
        if self.operator == "=~":
            return not re.match(f"^(?:{self.value})", "")
        return self.operator == "!=" and self.value == ""

    def column(self, tags: Column) -> Column:
        start = f"^(?:{checked(self.value)})" if self.operator.endswith("~") else ""
        if self.tag == "__tag":
            keys = F.map_keys(tags)
            return {
                "=": lambda: F.array_contains(keys, self.value),
                "!=": lambda: ~F.array_contains(keys, self.value),
                "^=": lambda: F.exists(keys, lambda k: k.startswith(self.value)),
                "=~": lambda: F.exists(keys, lambda k: k.rlike(start)),
                "!=~": lambda: ~F.exists(keys, lambda k: k.rlike(start)),
            }[self.operator]()
        v = F.coalesce(tags[self.tag], F.lit(""))  # an absent tag is like an empty one
        return {
            "=": lambda: v == self.value,
            "!=": lambda: v != self.value,
            "^=": lambda: v.startswith(self.value),
            "=~": lambda: v.rlike(start),
            "!=~": lambda: ~v.rlike(start),
        }[self.operator]()


def find_by_tag(defs: DataFrame, *expressions: str, since: int | None = None, tags: str = "tags") -> DataFrame:
    """The definitions that pass all expressions, one of which at least must ask for a value."""
    parsed = list(dict.fromkeys(TagExpression.of(e) for e in expressions))
    if not any(e.needs_value() for e in parsed):
        raise ValueError("one expression must ask for a tag's value")
    if since is not None:
        defs = defs.where(F.col("last_update") >= since)
    for e in parsed:
        defs = defs.where(e.column(F.col(tags)))
    return defs


def with_meta_tags(defs: DataFrame, rules: list[tuple[list[str], dict[str, str]]]) -> DataFrame:
    """Virtual tags added to the series that pass a rule's expressions; a series' own tags stay as they are, and of rules the first counts."""
    tags = F.col("tags")
    for expressions, virtual in rules:
        passes = F.lit(True)
        for e in expressions:
            passes = passes & TagExpression.of(e).column(F.col("tags"))
        add = F.create_map(*[x for k, v in virtual.items() for x in (F.lit(k), F.lit(v))])
        tags = F.when(passes, _added(tags, add)).otherwise(tags)
    return defs.withColumn("tags", tags)


def _added(tags: Column, more: Column) -> Column:
    """tags with those of more that aren't there yet."""
    return F.map_concat(tags, F.map_filter(more, lambda k, v: ~F.map_contains_key(tags, k)))


def tag_terms(defs: DataFrame) -> DataFrame:
    """tag, value, n."""
    return defs.select(F.explode("tags").alias("tag", "value")).groupBy("tag", "value").agg(F.count("*").alias("n"))


def tag_names(defs: DataFrame, pattern: str = "") -> DataFrame:
    return defs.select(F.explode(F.map_keys("tags")).alias("tag")).where(F.col("tag").rlike(f"^(?:{checked(pattern)})")).distinct()


def tag_values(defs: DataFrame, tag: str, pattern: str = "") -> DataFrame:
    """value, n."""
    return defs.where(F.map_contains_key("tags", F.lit(tag))).groupBy(F.col("tags")[tag].alias("value")).agg(F.count("*").alias("n")).where(F.col("value").rlike(f"^(?:{checked(pattern)})"))


def complete_tags(defs: DataFrame, prefix: str, *expressions: str, limit: int = 100) -> DataFrame:
    """The first tags with a prefix, among the series that pass the expressions; tags asked for in those aren't offered."""
    own = find_by_tag(defs, *expressions) if expressions else defs
    asked = [TagExpression.of(e).tag for e in expressions]
    tags = own.select(F.explode(F.map_keys("tags")).alias("tag")).where(F.col("tag").startswith(prefix) & ~F.col("tag").isin(asked)).distinct()
    return tags.orderBy("tag").limit(limit)


def complete_values(defs: DataFrame, tag: str, prefix: str, *expressions: str, limit: int = 100) -> DataFrame:
    own = find_by_tag(defs, *expressions) if expressions else defs
    values = own.select(F.col("tags")[tag].alias("value")).where(F.col("value").startswith(prefix)).distinct()
    return values.orderBy("value").limit(limit)


def delete(defs: DataFrame, pattern: str) -> DataFrame:
    """What is left without the series a pattern finds, or that are below a path it finds."""
    depth = len(_nodes(pattern))
    return defs.where(~glob_filter(pattern, F.array_join(F.slice(F.split("name", r"\."), 1, depth), ".")))


def delete_by_tag(defs: DataFrame, *expressions: str, older_than: int | None = None) -> DataFrame:
    return defs.join(found_by_tag(defs, *expressions, older_than=older_than).select("sid"), "sid", "left_anti")


def found_by_tag(defs: DataFrame, *expressions: str, older_than: int | None = None) -> DataFrame:
    """What delete_by_tag takes away: to be looked at before (a dry run), or to be kept elsewhere (an archive)."""
    gone = find_by_tag(defs, *expressions)
    return gone if older_than is None else gone.where(F.col("last_update") < older_than)


def added(defs: DataFrame, more: DataFrame) -> DataFrame:
    """Definitions with others added; of two with one sid the later counts."""
    both = defs.unionByName(more)
    columns = [c for c in both.columns if c != "sid"]
    return both.groupBy("sid").agg(F.max_by(F.struct(*columns), "last_update").alias("d")).select("sid", "d.*").select(*defs.columns)


def controlled(defs: DataFrame, messages: DataFrame) -> DataFrame:
    """Definitions after control messages: defs' columns and `action`, add or delete (by sid). Deletions come first."""
    left = defs.join(messages.where("action = 'delete'").select("sid"), "sid", "left_anti").select(*defs.columns)
    return added(left, messages.where("action = 'add'").select(*defs.columns))


Rule = tuple[list[str], dict[str, str]]


def upserted(rules: list[Rule], expressions: list[str], virtual: dict[str, str]) -> list[Rule]:
    """Meta tag rules with one put in, or in the place of that with the same expressions; without tags it goes."""
    at = sorted(expressions)
    kept = [(e, virtual) if sorted(e) == at else (e, t) for e, t in rules]
    kept = kept if any(sorted(e) == at for e, _ in rules) else [*kept, (expressions, virtual)]
    return [(e, t) for e, t in kept if t]


def prune(defs: DataFrame, rules: list[tuple[str, int]], now: int) -> DataFrame:
    """What is left when paths go whose series are all older than their rule allows. rules: (pattern, seconds; 0: never), the first that fits; else never."""
    cutoff = F.lit(0)
    for pattern, stale in reversed(rules):
        cutoff = F.when(F.col("name").rlike(checked(pattern)), F.lit(now - stale if stale else 0)).otherwise(cutoff)
    last = F.max("last_update").over(Window.partitionBy("org", "name"))
    return defs.withColumn("_last", last).where(F.col("_last") >= cutoff).drop("_last")
