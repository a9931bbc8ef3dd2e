"""SentencePiece encoding and decoding by a table of distinct marked words.

In a model whose pieces hold the white-space marker only at their start, no piece
reaches over the place where a word ends and the next marker begins. A text is then
a sequence of marked words (markers and what follows up to the next marker), each
segmented on its own. A task segments each distinct marked word it meets once, keeps
the result in a table, and joins ids back by position. The table is emptied when it
reaches a fixed size, so a task's memory doesn't follow its input; no rows are
shuffled, and a lost task is simply run again.

Null texts count as empty, which have no ids and decode to "". Rows, repeated ones
included, are kept one for one; columns other than the text's pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm import textbytes

MARK = "▁"
#: The table of a task is emptied beyond so many words, or so many characters in them.
TABLE_WORDS, TABLE_CHARS = 300_000, 8_000_000

_MARKED = re.compile(" *[^ ]+| +")


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def separable(model: str) -> bool:
    """Whether all pieces have the marker at their start only, so that marked words can be segmented alone."""
    sp = _processor(model)
    return all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def _marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker (which the library adds to what it's given)."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [m[1:] for m in _MARKED.findall(" " + text)]
    return text.split(" ")


class _Table:
    """Distinct marked words and their ids (as bytes) and decoded texts."""

    def __init__(self, model: str):
        self.sp = _processor(model)
        self.alone = self.sp.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.chars = 0

    def add(self, words: list[str]) -> None:
        if len(self.ids) + len(words) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.ids, self.text, self.chars = {}, {}, 0
        new = [w for w in words if w not in self.ids]
        got = self.sp.encode(new, num_threads=1)
        for w, ids, text in zip(new, got, self.sp.decode(got, num_threads=1) if new else [], strict=True):
            if not w:  # a marker with nothing behind it
                ids, text = [self.alone], ""
            self.ids[w] = np.array(ids, np.int32).tobytes()
            self.text[w] = w if text == w else text
            self.chars += len(w)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text (array of int), and the text decoded from them if a name is given for it.

    Equal to the library's encode() and decode() without begin or end ids. Raises for a
    model whose pieces cross markers.
    """
    if not separable(model):
        raise ValueError("this model has pieces across white-space markers")
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    extra += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([f for f in docs.schema.fields if f.name not in {e.name for e in extra}] + extra)
    keep = [f.name for f in schema.fields[: -len(extra)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(model)
        for batch in batches:
            col = textbytes.column_of(batch, text)
            for first, last, _, _ in textbytes.chunks(col):
                texts = [_marked_words(t) for t in col.slice(first, last - first).to_pylist()]
                code: dict[str, int] = {}
                for ws in texts:
                    for w in ws:
                        if w not in code:
                            code[w] = len(code)
                table.add(list(code))
                own = [table.ids[w] for w in code]
                lens = np.fromiter(map(len, own), np.int64, len(own)) // 4
                flat = np.frombuffer(b"".join(own), np.int32)
                at = np.concatenate([[0], np.cumsum(lens)])[:-1] if len(own) else lens
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                seq = np.fromiter((code[w] for ws in texts for w in ws), np.int64, int(sizes.sum()))
                n = lens[seq]
                ends = np.concatenate([[0], np.cumsum(n)])
                values = flat[np.repeat(at[seq] - ends[:-1], n) + np.arange(ends[-1])] if len(seq) else flat
                offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
                out = [batch.column(k).slice(first, last - first) for k in keep]
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())))
                if decoded:
                    out.append(pa.array([" ".join([table.text[w] for w in ws]) for ws in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*keep, ids, *([decoded] if decoded else [])])

    return docs.select(*{text: 0, **dict.fromkeys(keep)}).mapInArrow(run, schema)


def ids_digest(ids: str | Column) -> Column:
    """SHA-256 (lowercase hex) of the decimal ids joined by commas."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.array_join(col.cast("array<string>"), ","), 256)
