"""Operator 3: token counts by overlap resynchronisation.

A document of up to ``chunk_chars`` is one chunk, encoded whole by the tokenizer library. A longer one is
encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a stable boundary: a position
in their overlap where both encodings start a token and white space follows a character that is
none. No pre-token and no special string spans such a position and the pattern never looks back, so
what either side gives there is what the whole text gives. Where an overlap has none, it is widened,
up to the whole text.

Defined cases: null text is empty and has 0 bytes and tokens; every row is counted, repeated ids and null ids
too; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .base import map_batches


def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splice_count(text: str, tok, chunk: int, overlap: int) -> int:
    """Tokens of the whole text, from encodings of overlapping chunks."""

    def starts_of(a: int, z: int) -> np.ndarray:
        return np.array([s for s, _ in tok.encode(text[a:z], add_special_tokens=False).offsets], np.int64) + a

    n, total, floor, size = len(text), 0, 0, chunk  # tokens before floor are counted; floor is a proven boundary
    end = min(n, size)
    left = starts_of(0, end)
    while end < n:
        width, cut = overlap, None
        while cut is None and width < chunk and end - width > floor:
            begin = end - width
            stop = min(n, begin + chunk)
            right = starts_of(begin, stop)
            both = np.intersect1d(left[(left > begin) & (left < end)], right)
            good = [p for p in both.tolist() if text[p].isspace() and not text[p - 1].isspace()]
            cut = good[len(good) // 2] if good else None
            width *= 2
        if cut is None:  # no boundary in any overlap: one longer chunk from the last proven boundary
            size *= 2
            end = min(n, floor + size)
            left = starts_of(floor, end)
        else:
            total += int(((left >= floor) & (left < cut)).sum())
            floor, left, end, size = cut, right, stop, chunk
    return total + int((left >= floor).sum())


def count_all(texts: list[str], tok, chunk: int, overlap: int) -> list[int]:
    """Tokens of each text: one encoding of the whole text, or of overlapping chunks where it is huge."""
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    a = 0
    while a < len(short):
        z, size = a, 0
        while z < len(short) and size < 500_000:
            size += len(texts[short[z]])
            z += 1
        for i, e in zip(short[a:z], tok.encode_batch_fast([texts[i] for i in short[a:z]], add_special_tokens=False)):
            out[i] = len(e.ids)
        a = z
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = splice_count(t, tok, chunk, overlap)
    return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk_chars: int = 16_384, overlap_chars: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of documents. One map over the rows, no shuffle."""

    def make():
        tok = _library(tokenizer)

        def f(b):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = count_all(texts, tok, chunk_chars, overlap_chars)
            return [b.column(0), [len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return f

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
