"""Operator 12: periodic runs of words, by a harmonic grid and prefix hashes.

A run is a stretch of consecutive words with smallest period q and a length of at least max(``LEAST``, 2 q) that no
neighbouring word extends keeping period q. A stretch of 2 q words or more holds two neighbouring points of the grid
0, q, 2 q, ..., whose words are then equal. So, for all texts of a batch together:

1. all (period, grid point) pairs are laid out, n/q for each period q up to n/2, in bounded pieces; a pair whose two
   words differ has a common extension of nothing and is done;
2. prefix hashes, cumulated sums of word values times powers of one odd base modulo 2**64, give the longest common
   extension to the right and to the left of all pairs left, by one binary search over all of them at once;
3. what the extensions span is deduplicated, the smallest period of a span stays (its multiples span the same words);
4. the words of every run are compared. A hash can only make an extension too long; where it did, the spans of
   that text and period are read off the words themselves.

Defined cases: null and empty texts have no words and no runs, and collapse to the empty text; repeated rows and null
ids are worked through like any other; of runs with one start the shorter period comes first; very long texts are
read whole (the pairs are laid out in pieces of ``PAIRS``); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches

LEAST = 12
PAIRS = 1 << 20  # pairs laid out together
WORDS = 1 << 18  # words of texts worked through together; a longer text makes a piece of its own
_BASE = 0x9E3779B97F4A7C15
OUTPUT = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The base's powers 0 to n - 1, modulo 2**64; at most those of a piece of WORDS are kept."""
    global _POWERS
    if len(_POWERS) >= n:
        return _POWERS
    steps = np.full(max(n, WORDS), _BASE, np.uint64)
    steps[0] = 1
    out = np.cumprod(steps)
    if n <= WORDS:
        _POWERS = out
    return out


def _values(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point) of all texts in pieces of about PAIRS; grid points count from the start of all words."""
    most = n // 2
    doc = np.repeat(np.arange(len(n)), most)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    size = (n[doc] - 1) // q
    ends = np.cumsum(size)
    a = 0
    while a < len(q):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        row = np.repeat(np.arange(a, z), size[a:z])
        step = np.arange(len(row)) - np.repeat(ends[a:z] - size[a:z] - (ends[a - 1] if a else 0), size[a:z])
        yield doc[row], q[row], first[doc[row]] + step * q[row]
        a = z


def _extensions(prefix: np.ndarray, power: np.ndarray, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Of each pair (i, i + q): how many words, at most `most`, are equal from there on, or before there."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
    shift = power[q]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        a = i[open_] - mid if back else i[open_]
        z = a + mid
        b = q[open_]
        same = (prefix[z] - prefix[a]) * shift[open_] == prefix[z + b] - prefix[a + b]
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def _stretches(w: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, end) of all maximal stretches of period q and at least 2 q words, by the words themselves."""
    same = np.concatenate(([0], (w[:-q] == w[q:]).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(same))
    return [(a, z + q) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()) if z - a >= q]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Of each text, given as word numbers: its runs (start, length, period), by start, then period."""
    n = np.array([len(t) for t in texts], np.int64)
    if not n.sum():
        return [[] for _ in texts]
    w = np.concatenate(texts)
    first = np.cumsum(n) - n
    power = _powers(len(w) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values(w) * power[: len(w)])))
    spans: dict = {}
    for doc, q, i in _pairs(first, n):
        same = np.flatnonzero(w[i] == w[i + q])
        doc, q, i = doc[same], q[same], i[same]
        right = _extensions(prefix, power, i, q, first[doc] + n[doc] - q - i, False)
        left = _extensions(prefix, power, i, q, i - first[doc], True)
        long = np.flatnonzero((left + right >= q) & (left + right + q >= LEAST))
        start, end = i[long] - left[long], i[long] + q[long] + right[long]
        for d, s, e, p in set(zip(doc[long].tolist(), start.tolist(), end.tolist(), q[long].tolist())):
            spans.setdefault((d, s, e), set()).add(p)
    best: list[dict] = [{} for _ in texts]
    wrong = set()
    for (d, s, e), periods in spans.items():
        for p in sorted(periods):
            if np.array_equal(w[s : e - p], w[s + p : e]):
                best[d][s - int(first[d]), e - int(first[d])] = p
                break
            wrong.add((d, p))
    for d, p in wrong:  # a hash has deceived: what this period spans is read off the words
        for s, e in _stretches(texts[d], p):
            if e - s >= LEAST:
                best[d][s, e] = min(p, best[d].get((s, e), p))
    return [sorted(((s, e - s, p) for (s, e), p in x.items()), key=lambda r: (r[0], r[2])) for x in best]


def seeded_repeats(doc_id, n: int) -> np.ndarray | None:
    """For every tenth document by crc32 of its id, which original word each of its n words becomes: from word a on the
    next p words are said over and over. A null id has no repeats."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def find_runs(docs: DataFrame, rewrite: Callable | None = None) -> DataFrame:
    """OUTPUT, one row for each row of documents: the runs of its words, and its words joined by single blanks without
    those that a run holds after its first period. `rewrite(doc_id, n)` may give the number of the word that each of the
    n words is replaced with. One map, no shuffle."""

    def make():
        def work(ids, said, out):
            numbers = []
            for k, (doc_id, words) in enumerate(zip(ids, said)):
                at = rewrite(doc_id, len(words)) if rewrite else None
                if at is not None:
                    said[k] = words = [words[x] for x in at.tolist()]
                known: dict = {}
                numbers.append(np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words)))
            for words, found in zip(said, runs_of(numbers)):
                if found:
                    keep = np.ones(len(words), bool)
                    for s, length, p in found:
                        keep[s + p : s + length] = False
                    words = [words[x] for x in np.flatnonzero(keep).tolist()]
                out[0].append([{"start": s, "length": length, "period": p} for s, length, p in found])
                out[1].append(b" ".join(words).decode())

        def f(b):
            ids = b.column(0).to_pylist()
            out: tuple[list, list] = ([], [])
            said, size, a = [], 0, 0
            for k, t in enumerate(b.column(1)):
                words = (t.as_py() or "").encode().split()  # bytes split at blank and \x09 to \x0d alone
                if said and size + len(words) > WORDS:
                    work(ids[a:k], said, out)
                    said, size, a = [], 0, k
                said.append(words)
                size += len(words)
            work(ids[a:], said, out)
            return [b.column(0), *out]

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), OUTPUT, make)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of find_runs()'s rows; the
    run told of is the longest, then the first, then that of the shortest period."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    top = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("short"), r.start.alias("start"), r.period.alias("period")))), F.lit(0))
    q = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.start.alias("start"), (-top.short).alias("length"), top.period.alias("period"), lines.alias("lines"), "collapsed")
    each = F.concat(F.array_join("lines", "\n"), F.when(F.col("n_runs") > 0, "\n").otherwise(""))
    return q.select("doc_id", "n_runs", "start", "length", "period", F.floor(F.expr("1000 * length div period")).cast("long").alias("exponent_milli"), F.sha2(each, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
