"""Operator 1: chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` per turn, encoded once
with offsets, and the spans of the turns under the loss are intersected with the token spans by
binary search. Inside roles and texts every ``<|`` gets a backslash between its two characters (one
more if there are some already), so no text can forge a control string and the original comes back.

Turns of a conversation arrive sorted (hash by conversation, sort by turn), so memory holds one part
of one conversation: above ``max_part_chars`` the rendering is cut between turns into further parts.
Control strings are added tokens, hence a cut there changes no token.

Defined cases: null text or role is empty; null conv_id is a conversation of its own; turns that tie
are ordered by role, then text; repeated rows are repeated turns; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import ship

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
OUTPUT = "conv_id long, part int, n_turns int, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<tinyint>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def render(turns: list[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the sorted spans of texts under the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role in loss_roles and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def mask_of(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each token that lies in a span: two binary searches a span in the sorted token spans."""
    mask = np.zeros(len(starts), np.int8)
    if spans and len(starts):
        s = np.asarray(spans)
        for a, b in zip(np.searchsorted(ends, s[:, 0], "right"), np.searchsorted(starts, s[:, 1], "left")):
            mask[a:b] = 1
    return mask


def _tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([START, SEP, END])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def chat_format(conversations: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = ("assistant",), max_part_chars: int = 1_000_000) -> DataFrame:
    """OUTPUT rows: for each conversation its parts in order, next to one another."""
    ship(conversations.sparkSession)
    struct = T.StructType.fromDDL(OUTPUT)
    arrow, roles = to_arrow_schema(struct), frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, rows, chars = _tokenizer(tokenizer), [], 0
        now, part, turns, size = (), 0, [], 0

        def flush():
            nonlocal part, turns, size, chars
            text, spans = render(turns, roles)
            e = tok.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, np.int32).reshape(-1, 2)
            rows.append((now[0], part, len(turns), text, np.array(e.ids, np.int32), at[:, 0], at[:, 1], mask_of(spans, at[:, 0], at[:, 1])))
            part, turns, size, chars = part + 1, [], 0, chars + len(text)

        def batch():
            nonlocal rows, chars
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
            rows, chars = [], 0
            return out

        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (conv,) != now:
                    if turns:
                        flush()
                    now, part = (conv,), 0
                elif size > max_part_chars:
                    flush()
                if chars > 4 * max_part_chars:
                    yield batch()
                turns.append((role or "", text or ""))
                size += len(turns[-1][1])
        if turns:
            flush()
        if rows:
            yield batch()

    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, struct)


def read_back(formatted: DataFrame) -> DataFrame:
    """From chat_format's rows, in their order: per conversation the digests of its turns and of all text
    under the loss mask, as the output has them. Narrow: parts of a conversation are neighbours."""
    struct = T.StructType.fromDDL("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        done = []

        def close():
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        for b in batches:
            for conv, text, starts, ends, mask in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now is None or (conv,) != now:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for m in _TURN.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, np.int8), [0]))))
                for a, z in zip(edge[::2], edge[1::2]):
                    under = unescape(text[starts[a] : ends[z - 1]])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(text)
                state[5] += len(mask)
                state[6] += sum(mask)
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*done), arrow)], schema=arrow)

    return formatted.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(run, struct)
