"""Operator 10: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding, for documents in blocks of about ``block_chars``:

1. each task splits its rows into pre-tokens and numbers the distinct ones of a block; what a
   position holds is a number into the block's words (the positions, packed);
2. the blocks' distinct words are shuffled by word and sorted, so each word of the corpus meets in
   one run, is encoded once, and its ids go back to every block that asked. The blocks pre-aggregate:
   the commonest word has one row a block, not one an occurrence;
3. ids and positions meet by block, and each row's ids are put together by position.

Text is never shuffled and no dictionary of words is broadcast or collected. A block is numbered by
its input partition, so the plan reads its input twice in the same splits; a word count and checksum
of each block make a disagreement an error rather than a wrong result.

Decoding joins ids to the token-byte table (bounded by the vocabulary, so each worker holds it).

Defined cases: null text is empty and has no ids; each row is encoded, repeated ids too; null doc_id
is kept; a very long text makes a block of its own and is worked through whole; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import map_batches, ship, slices
from .pretokens import pieces


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


class _Numbered(dict):
    """Numbers keys as they first come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int):
    """(block id, its words, [(doc_id, positions)])"""
    ctx = TaskContext.get()
    first, k = (ctx.partitionId() if ctx else 0) << 32, 0
    words, rows, size = _Numbered(), [], 0
    for b in (x for whole in batches for x in slices(whole)):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p = pieces(text or "")
            rows.append((doc, np.fromiter(map(words.__getitem__, p), np.uint32, len(p))))
            size += len(text or "")
            if size >= block_chars:
                yield first + k, words, rows
                k, words, rows, size = k + 1, _Numbered(), [], 0
    if rows:
        yield first + k, words, rows


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _check(words) -> int:
    return zlib.crc32("\0".join(words).encode())


def bpe_encode(docs: DataFrame, rank_file: str, block_chars: int = 12_000_000, then: tuple[str, Callable[[], Callable]] | None = None) -> DataFrame:
    """(doc_id long, ids array<int>) for each row of documents. `then`, a schema and a factory as map_batches() takes them, is
    applied to these rows where they are put together, so that a task needs one Python worker for both."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    word_type = T.StructType.fromDDL("block long, word_no int, word string")
    coded_type = T.StructType.fromDDL("block long, crc long, nos binary, lens binary, ids binary")
    pos_type = T.StructType.fromDDL("block long, n_words int, crc long, doc_ids array<long>, counts array<int>, positions binary")
    ids_type = T.StructType.fromDDL("doc_id long, ids array<int>")
    out_type = T.StructType.fromDDL(then[0]) if then else ids_type
    word_arrow, coded_arrow, pos_arrow, ids_arrow, out_arrow = map(to_arrow_schema, (word_type, coded_type, pos_type, ids_type, out_type))

    def distinct_words(batches):
        for block, words, _ in _blocks(batches, block_chars):
            every = list(words)
            for i in range(0, len(every), 50_000):
                part = every[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part, pa.string())], schema=word_arrow)
            # the checksum travels as a word number that no word has
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([str(_check(every))])], schema=word_arrow)

    def encode(batches):
        one, last, ids = encoding(rank_file)._core_bpe.encode_single_piece, None, b""
        blocks, nos, found, held = [], [], [], 0

        def flush():
            """What is held, as one packed row a block."""
            block, no = np.concatenate(blocks), np.concatenate(nos)
            order = np.lexsort((no, block))
            block, no = block[order], no[order]
            lens = np.fromiter(map(len, found), np.int64, len(found))[order] // 4
            edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            rows = []
            for x, z in zip(edge[:-1], edge[1:]):
                flat = np.frombuffer(b"".join(found[k] for k in order[x:z]), np.uint32)
                rows.append((int(block[x]), None, _pack(np.diff(no[x:z], prepend=0)), _pack(lens[x:z]), _pack(flat)))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), coded_arrow)], schema=coded_arrow)

        for b in batches:
            no, words, keep = b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(1).to_numpy() >= 0
            for k in np.flatnonzero(~keep):
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t.type) for x, t in zip((b.column(0)[int(k)].as_py(), int(words[k]), None, None, None), coded_arrow)], schema=coded_arrow)
            for k in np.flatnonzero(keep).tolist():
                if words[k] != last:  # rows are sorted by word: each distinct word once
                    last, ids = words[k], np.array(one(words[k].encode()), np.uint32).tobytes()
                found.append(ids)
            blocks.append(b.column(0).to_numpy()[keep])
            nos.append(no[keep])
            held += int(keep.sum())
            if held > 300_000:
                yield flush()
                blocks, nos, found, held = [], [], [], 0
        if held:
            yield flush()

    def positions(batches):
        for block, words, rows in _blocks(batches, block_chars):
            crc = _check(words)
            for i in range(0, len(rows), 500):
                part = rows[i : i + 500]
                flat = np.concatenate([p for _, p in part])
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t.type) for x, t in zip((block, len(words), crc, [d for d, _ in part], [len(p) for _, p in part], _pack(flat)), pos_arrow)], schema=pos_arrow)

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        nos, lens, data, crc = [], [], [], None
        for b in right.to_batches():
            for c, no, n, ids in zip(*(b.column(x).to_pylist() for x in ("crc", "nos", "lens", "ids"))):
                if c is not None:
                    crc = c
                else:
                    nos.append(np.cumsum(_unpack(no), dtype=np.int64))
                    lens.append(_unpack(n).astype(np.int64))
                    data.append(_unpack(ids))
        no, n, data = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nos, lens, data))
        begin = np.cumsum(n) - n
        finish = then[1]() if then else None
        order = np.argsort(no, kind="stable")
        n, begin = n[order], begin[order]
        out = []
        for b in left.to_batches():
            for words, want, doc_ids, counts, packed in zip(*(b.column(c).to_pylist() for c in ("n_words", "crc", "doc_ids", "counts", "positions"))):
                if crc != want or len(n) != words:
                    raise RuntimeError(f"block {key}: the two readings of the input disagree")
                pos = _unpack(packed).astype(np.int64)
                size = n[pos] if len(pos) else np.zeros(0, np.int64)
                upto = np.cumsum(size)
                at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[pos] - (upto - size), size)
                ids = data[at].astype(np.int32)
                ends = np.concatenate(([0], upto))[np.cumsum([0, *counts])]
                rows = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)).cast(ids_arrow.field("ids").type)], schema=ids_arrow)
                if finish:
                    rows = pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(finish(rows), out_arrow)], schema=out_arrow)
                out.append(rows)
        return pa.Table.from_batches(out, schema=out_arrow)

    coded = src.mapInArrow(distinct_words, word_type).repartition("word").sortWithinPartitions("word").mapInArrow(encode, coded_type)
    placed = src.mapInArrow(positions, pos_type)
    return placed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, out_type)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}


def bpe_decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids); bytes need not be valid UTF-8. Null ids: no bytes."""

    def make():
        get = token_bytes(rank_file).__getitem__

        def f(b):
            return [b.column(0), [b"".join(map(get, x or ())) for x in b.column(1).to_pylist()]]

        return f

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, bytes binary", make)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def _numerals(path: str) -> dict[int, str]:
    return {i: str(i) for i in token_bytes(path)}


def _digests(rank_file: str) -> Callable[[], Callable]:
    """A factory for map_batches(): digests of the ids of (doc_id, ids) and of the bytes that they decode to."""

    def make():
        text, raw = _numerals(rank_file).__getitem__, token_bytes(rank_file).__getitem__
        sha = hashlib.sha256

        def f(b):
            n, ids, out = [], [], []
            flat, off = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()  # offsets of a slice point into the whole
            for a, z in zip(off[:-1], off[1:]):
                x = flat[a:z].tolist()
                n.append(len(x))
                ids.append(sha(",".join(map(text, x)).encode()).hexdigest())
                out.append(sha(b"".join(map(raw, x))).hexdigest())
            return [b.column(0), n, ids, out]

        return f

    return make


def bpe_digests(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what each row was encoded to, and what its ids decode to."""
    return map_batches(encoded.select("doc_id", "ids"), DIGESTS, _digests(rank_file))


def bpe_round_trip(docs: DataFrame, rank_file: str) -> DataFrame:
    """bpe_digests() of bpe_encode(), decoded where the ids are put together."""
    return bpe_encode(docs, rank_file, then=(DIGESTS, _digests(rank_file)))
