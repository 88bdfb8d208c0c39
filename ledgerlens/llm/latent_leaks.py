"""Operator 6: benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of ``WINDOW`` words (a step of half that), weighted by TF-IDF;
   document frequencies count over all documents.
2. A distributed randomised SVD (range finder with power iterations; each task adds up its share of
   A^T A Q) gives the passages' leading right singular vectors, the latent space.
3. Every document is cut into the same windows; a window's vector is folded into the latent space, and
   its cosine with all passages comes from one matrix product. A cosine of ``cosine`` or more makes
   a candidate, if the window also holds ``share`` of the passage's weight. That weight is counted over the
   terms themselves, as the latent space keeps only part of it; windows whose own words do not weigh that
   much are told before any vector is made.
4. A candidate is checked in the document's own words around the window: the longest common
   subsequence with the whole item must cover ``cover`` of it; or, for paraphrases, ``loose`` of it if the
   item's answer (its last sentence) is there too, in order; or ``PASSAGE_COVER`` of the passage that the window
   resembles, so that part of an item copied alone is found.

Documents are read twice and never shuffled. The latent model is sent to executors for at most
``slice_items`` items and about ``slice_chars`` characters of them at a time; a larger benchmark is worked through in
slices, each with its own latent space. What is sent grows with the words of the slice's passages, each kept as the sorted list of
its terms; cosines are taken against ``PASSAGES`` passages at a time.

Defined cases: null or empty texts and items leak nothing; null ids are reported as null; repeated rows
are reported row by row; items of fewer than ``LEAST_WORDS`` words must be covered whole; an empty
benchmark or table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, lean, map_batches, ship, slices, without_ids
from .scratch import Scratch
from .shingles import in_batches, word_hashes

WINDOW, HALF, LEAST_WORDS = 32, 16, 8
PASSAGE_COVER = 0.85
PASSAGES = 4_096
OUTPUT = "doc_id long, item_id long, cosine double, shared int, item_words int, coverage double, answer boolean, start_word int"
_SIGNS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of all words: lower case, ASCII signs as blanks."""
    return word_hashes([(t or "").lower().encode() for t in texts], _SIGNS)


def _in(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(how many documents hold each word, how many documents there are)."""
    size = len(vocabulary)

    def run(batches):
        lean()
        df = np.zeros(size + 1, np.int64)
        for b in (x for whole in batches for x in slices(whole)):
            texts = b.column(0).to_pylist()
            for x, y in in_batches(texts):
                h, of = words(texts[x:y])
                v = _in(vocabulary, h)
                of, v = of[v >= 0], v[v >= 0]
                if (y - x) * size < 8_000_000:
                    flags = np.zeros((y - x, size), bool)
                    flags[of, v] = True
                    df[:size] += flags.sum(0)
                else:
                    df[:size] += np.bincount(np.unique(of * size + v) % size, minlength=size)
            df[size] += len(texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["k", "n"])
        give_back()

    got = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 1, np.int64)
    df[got.k.to_numpy(np.int64)] = got.n
    return df[:size], int(df[size])


def _windows(n: int) -> list[tuple[int, int]]:
    """The windows of n words, as ranges of half windows."""
    halves = -(-n // HALF)
    return [(i, min(i + 2, halves)) for i in range(max(1, halves - 1))] if n else []


def _rows(hashes: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray):
    """Of one item: for each passage (terms, weights, range of words)."""
    v = _in(vocabulary, hashes)
    for a, z in _windows(len(v)):
        t = np.unique(v[a * HALF : z * HALF])
        t = t[t >= 0]
        if (idf[t] > 0).any():
            yield t, idf[t], (a * HALF, min(z * HALF, len(v)))


def _summed(items: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all items of the matrices that make() adds up in each task."""

    parts = 16  # bands of rows, each added up in a task of its own

    def run(batches):
        total, add = np.zeros(shape), make()
        for b in batches:
            for t in b.column(0).to_pylist():
                add(total, words([t])[0])
        bands = [(k, x.tobytes()) for k, x in enumerate(np.array_split(total, parts)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in bands], pa.int32()), pa.array([x for _, x in bands], pa.binary())], names=["k", "m"])
        give_back()

    def add_up(batches):
        total: dict = {}
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(m)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["k", "m"])

    kind = "k int, m binary"
    got = {r.k: np.frombuffer(bytes(r.m)) for r in items.select("text").mapInArrow(run, kind).repartition(parts, "k").mapInArrow(add_up, kind).collect()}
    return np.concatenate([got[k].reshape(x.shape) if k in got else x for k, x in enumerate(np.array_split(np.zeros(shape), parts))])


def randomised_svd(items: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int, over: int = 16, power: int = 2, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors [words, rank], singular values) of the passages' TF-IDF matrix."""
    size = len(vocabulary)
    width = min(rank + over, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]

    def through(basis):
        def make():
            def add(total, h):
                for t, w, _ in _rows(h, vocabulary, idf):
                    total[t] += np.outer(w, w @ basis[t])

            return add

        return make

    for _ in range(power):
        q = np.linalg.qr(_summed(items, through(q), (size, width)))[0]

    def gram():
        def add(total, h):
            for t, w, _ in _rows(h, vocabulary, idf):
                y = w @ q[t]
                total += np.outer(y, y)

        return add

    value, vector = np.linalg.eigh(_summed(items, gram, (width, width)))
    best = np.argsort(-value)[:rank]
    best = best[value[best] > 1e-9 * max(value.max(), 1e-30)]
    return q @ vector[:, best], np.sqrt(np.maximum(value[best], 0))


def longest_common(places: dict[int, list[int]], region: list[int]) -> tuple[int, list[int]]:
    """(length of the longest common subsequence, the item's positions in one of them); places: an item
    word's positions, last first."""
    tails: list[int] = []
    link: list = []
    for h in region:
        for p in places.get(h, ()):
            k = bisect_left(tails, p)
            node = (p, link[k - 1] if k else None)
            if k == len(tails):
                tails.append(p)
                link.append(node)
            elif p < tails[k]:
                tails[k] = p
                link[k] = node
    out, node = [], link[-1] if link else None
    while node:
        out.append(node[0])
        node = node[1]
    return len(tails), out[::-1]


def _slice_leaks(docs: DataFrame, items: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int, cosine: float, share: float, cover: float, loose: float) -> DataFrame:
    spark = docs.sparkSession
    space, _ = randomised_svd(items, vocabulary, idf, rank)
    fold = (space * idf[:, None]).astype(np.float32)
    rows = items.collect()  # at most slice_items short texts
    item_words = [words([r.text])[0] for r in rows]
    passages, owner, weight, held, ranges = [], [], [], [], []
    for i, h in enumerate(item_words):
        for t, w, place in _rows(h, vocabulary, idf):
            ranges.append(place)
            passages.append((w @ space[t]).astype(np.float32))
            owner.append(i)
            weight.append(w @ w)
            held.append((len(held) * (len(vocabulary) + 1) + t).astype(np.int64))
    if not passages:
        return spark.createDataFrame([], OUTPUT)
    p = np.stack(passages)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    square, enough = np.append(idf * idf, 0), (1 - 1e-9) * share * np.array(weight)
    answers = [len(words([_SENTENCE.split(r.text.strip())[-1]])[0]) if r.text else 0 for r in rows]
    model = spark.sparkContext.broadcast((vocabulary, fold, square, enough, p, np.concatenate(held), np.array(owner), ranges, [r.item_id for r in rows], item_words, answers))

    def make():
        vocabulary, fold, square, enough, p, held, owner, ranges, ids, item_words, answers = model.value
        places, least = [], enough.min()
        for h in item_words:
            d: dict = {}
            for k in range(len(h) - 1, -1, -1):
                d.setdefault(int(h[k]), []).append(k)
            places.append(d)

        def check(i: int, k: int, h: np.ndarray, at: int):
            n = len(item_words[i])
            a = max(0, at - n)
            shared, where = longest_common(places[i], h[a : at + WINDOW + n].tolist())
            tail = min(answers[i], n)
            answer = tail > 0 and sum(k >= n - tail for k in where) >= 0.8 * tail
            lo, hi = ranges[k]
            part = hi - lo == WINDOW and sum(lo <= x < hi for x in where) >= PASSAGE_COVER * WINDOW
            ok = shared == n if n < LEAST_WORDS else shared >= cover * n or (shared >= loose * n and answer) or part
            return (shared, n, shared / n, answer) if ok else None

        def holding(v: np.ndarray, begin: np.ndarray, end: np.ndarray, w: np.ndarray, k: np.ndarray) -> np.ndarray:
            """Whether window w holds its share of passage k, by the terms that both have; windows are v[begin : begin + WINDOW]."""
            some, w = np.unique(w, return_inverse=True)
            at = begin[some][:, None] + np.arange(WINDOW)
            t = np.where(at < end[some][:, None], v[np.minimum(at, len(v) - 1)], -1)
            t = np.sort(np.where(t < 0, len(vocabulary), t), axis=1)
            t[:, 1:][t[:, 1:] == t[:, :-1]] = len(vocabulary)
            out = np.zeros(len(w), bool)
            for a in range(0, len(w), 20_000):
                u, q = t[w[a : a + 20_000]], k[a : a + 20_000]
                key = q[:, None] * np.int64(len(vocabulary) + 1) + u
                both = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
                out[a : a + 20_000] = (both * square[u]).sum(1) >= enough[q]
            return out

        def f(b):
            out = []
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x, y in in_batches(texts):
                h, of = words(texts[x:y])
                n = np.bincount(of, minlength=y - x)
                first = np.cumsum(n) - n
                halves = -(-n // HALF)
                base = np.cumsum(halves) - halves
                v = _in(vocabulary, h)
                at = np.flatnonzero(v >= 0)
                if not len(at):
                    continue
                cell = base[of[at]] + (at - first[of[at]]) // HALF
                mass = np.bincount(cell, weights=square[v[at]], minlength=int(halves.sum()))
                doc = np.repeat(np.arange(y - x), halves)
                pair = np.concatenate((doc[1:] == doc[:-1], [False]))
                mass[pair] += mass[np.flatnonzero(pair) + 1]
                # a window shares at most its own mass with a passage; where that is too little, no vector is made
                windows = np.flatnonzero((pair | np.repeat(halves == 1, halves)) & (mass >= least))
                if not len(windows):
                    continue
                need = np.zeros(len(doc), bool)
                need[windows] = True
                need[windows[pair[windows]] + 1] = True
                at = at[need[cell]]
                cell = (np.cumsum(need) - 1)[base[of[at]] + (at - first[of[at]]) // HALF]
                latent = np.zeros((int(need.sum()), fold.shape[1]), np.float32)
                for a in range(0, len(at), 4_000):
                    c = cell[a : a + 4_000]
                    edge = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                    latent[c[edge]] += np.add.reduceat(fold[v[at[a : a + 4_000]]], edge, axis=0)
                place = np.cumsum(need) - 1
                vector = latent[place[windows]]
                two = pair[windows]
                vector[two] += latent[place[windows[two] + 1]]
                vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
                best: dict = {}
                near, passage, cosines = [], [], []
                for a in range(0, len(p), PASSAGES):
                    s = vector @ p[a : a + PASSAGES].T
                    w, k = np.nonzero(s >= cosine)
                    near, passage, cosines = [*near, w], [*passage, k + a], [*cosines, s[w, k]]
                near, passage, cosines = np.concatenate(near), np.concatenate(passage), np.concatenate(cosines)
                begin = first[doc[windows]] + (windows - base[doc[windows]]) * HALF
                keep = holding(v, begin, (first + n)[doc[windows]], near, passage)
                for w, k, c_ in zip(near[keep].tolist(), passage[keep].tolist(), cosines[keep].tolist()):
                    c = int(windows[w])
                    d, i = int(doc[c]), int(owner[k])
                    start = (c - int(base[d])) * HALF
                    got = check(i, k, h[first[d] : first[d] + n[d]], start)
                    if got and got > best.get((d, i), ((),))[0]:
                        best[(d, i)] = (got, c_, start)
                out += [(doc_ids[x + d], ids[i], c, g[0], g[1], g[2], g[3], at_) for (d, i), (g, c, at_) in sorted(best.items())]
            return list(zip(*out)) if out else None

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), OUTPUT, make)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 96, cosine: float = 0.35, share: float = 0.25, cover: float = 0.6, loose: float = 0.45, slice_items: int = 4_096, slice_chars: int = 4_000_000) -> DataFrame:
    """OUTPUT: a row for each row of documents and item that leaks into it."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    slices = max(1, -(-size.n // slice_items), -(-size.chars // slice_chars))
    out = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else items
        vocabulary = np.unique(np.concatenate([words([r.text])[0] for r in part.collect()] or [np.zeros(0, np.uint64)]))
        if not len(vocabulary):
            continue
        df, n = document_counts(docs, vocabulary)
        idf = np.log((n + 1) / (df + 0.5)).clip(0)
        found = _slice_leaks(docs, part, vocabulary, idf, rank, cosine, share, cover, loose)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], OUTPUT)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents into which no item leaks; rows without an id stay."""
    leaked = Scratch(docs.sparkSession).keep(find_leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
    return without_ids(docs, "doc_id", leaked)
