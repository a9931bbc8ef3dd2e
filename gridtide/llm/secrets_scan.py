"""Secret scans: patterns for known forms, and a token-efficiency test for random strings.

Ordinary words fall into long pieces of a byte-pair vocabulary; random strings don't.
A run of key characters with few characters per token is reported as `token` unless
it is a digest of a known length, a UUID, or an identifier made of words. A word of an
identifier with LONG_WORD letters or more must be efficient itself, so that random letters of one case
aren't taken for a word.

Null texts count as empty and have no spans. Every row is kept, repeated ones too. The work grows in
proportion to a text's length (n log n in that of a run), whatever is in it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as a shorter match can't begin inside one
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_PART = re.compile(r"[+/_=-]+")
#: A part of an identifier: a number, or one or more words (lower case, upper case or capitalised) and at most four digits. Each letter can be taken in one way only, so there is no backtracking.
_WORDS = re.compile(r"[0-9]+|(?:[a-z]|[A-Z]+|(?:[a-z]{2,})?(?:[A-Z][a-z]{2,})*)[0-9]{0,4}")
#: From so many letters on a word must have so many characters a token.
LONG_WORD, WORD_CHARS_PER_TOKEN = 16, 2.0
_LONG_WORD = re.compile(r"[a-z]{%d,}|[A-Z]{%d,}" % (LONG_WORD, LONG_WORD))

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]),
    False,
)


def token_encoding(vocabulary: str):
    """A tiktoken encoding over a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_excluded(run: str, encoding) -> bool:
    """Known digests, UUIDs and identifiers made of words."""
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    if not all(_WORDS.fullmatch(p) for p in _PART.split(run)):
        return False
    return all(len(w) >= WORD_CHARS_PER_TOKEN * len(encoding.encode_ordinary(w)) for w in _LONG_WORD.findall(run))


def spans_of(text: str, encoding, most_chars_per_token: float) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        run = m.group()
        if not is_excluded(run, encoding) and len(run) < most_chars_per_token * len(encoding.encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def scan_secrets(docs: DataFrame, vocabulary: str, text: str = "text", spans: str = "spans", most_chars_per_token: float = 2.4) -> DataFrame:
    """docs with an array of (kind, start, end), in code points with the end exclusive, by start and then as KINDS.

    vocabulary: a tiktoken rank file. A run is reported as `token` if it has fewer than
    most_chars_per_token characters a token.
    """
    fields = [f for f in docs.schema.fields if f.name != spans]
    schema = T.StructType([*fields, T.StructField(spans, SPANS, False)])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = token_encoding(vocabulary)
        for batch in batches:
            got = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, encoding, most_chars_per_token)] if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(got, kind)], [*[f.name for f in fields], spans])

    return docs.select(*[f.name for f in fields]).mapInArrow(run, schema)
