"""Operator 2: language identification by string kernels.

The kernel of two texts is the cosine of the presence of their blended character n-grams (orders 1
to 3, white space as one character, case folded). Nyström landmarks stand for the kernel's feature
space, a ridge regression for each language against the rest is fitted there, and texts are scored by
batched matrix products: presence x landmarks x weights.

Fitted on at most ``per_language`` ids of each language and ``rows`` in all (by a hash of the id, languages
by turns; the bounds of the sample; of an id with several texts the least is learned). Landmarks are the
first ``landmarks`` of these by turns, or one for each language where there are more languages. Every text
is scored whole.

Defined cases: null text, or text with no letter: ``und`` with score 0; null languages are not
learned; with no row to learn from, every prediction is ``und``; equal values of two languages: the first by
name; repeated ids are scored row by row; very long texts are folded and scored whole, in pieces that
overlap; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import learnable, map_batches, held_out
from .ngrams import batches, presence

BITS, ORDERS = 13, (1, 2, 3)
_LETTER, _SPACE = re.compile(r"[^\W\d_]"), re.compile(r"\s+")


def _fold(text: str) -> str:
    return _SPACE.sub(" ", text.lower())


def _has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def _kernel(x: np.ndarray, marks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return (x @ marks.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None] / norms


def fit(docs: DataFrame, per_language: int = 300, landmarks: int = 192, ridge: float = 0.05, rows: int = 60_000) -> dict | None:
    """{langs, marks, norms, weights}, from learnable rows of docs with a language."""
    named = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & learnable())
    turn = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = named.withColumn("turn", turn).where(F.col("turn") <= per_language).distinct().orderBy("turn", "lang").limit(rows)
    found = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull() & learnable()).join(F.broadcast(ids), ["doc_id", "lang"])
    chosen = found.groupBy("doc_id", "lang", "turn").agg(F.min("text").alias("text"))

    def make():
        def f(b):
            marks = []
            for part in batches(b.column(3).to_pylist()):
                marks += [x.tobytes() for x in np.packbits(presence([_fold(t) for t in part], BITS, ORDERS), axis=1)]
            return [b.column(0), b.column(1), b.column(2), marks]

        return f

    got = map_batches(chosen.select("doc_id", "lang", "turn", "text"), "doc_id long, lang string, turn int, marks binary", make).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["turn", "lang", "doc_id"], kind="stable")
    x = np.unpackbits(np.frombuffer(b"".join(got.marks), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    langs = sorted(set(got.lang))
    y = np.where(got.lang.to_numpy()[:, None] == np.array(langs, object)[None, :], 1.0, -1.0)
    marks = x[: max(landmarks, len(langs))]
    norms = np.sqrt(np.maximum(marks.sum(1), 1))
    value, vector = np.linalg.eigh(_kernel(marks, marks, norms).astype(np.float64))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    phi = _kernel(x, marks, norms) @ whiten
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    w = np.linalg.solve(phi1.T @ phi1 + ridge * np.eye(phi1.shape[1]), phi1.T @ y)
    return {"langs": langs, "marks": marks.astype(bool), "norms": norms, "weights": (whiten @ w[:-1]).astype(np.float32), "bias": w[-1].astype(np.float32)}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); score: softmax of the one-versus-rest values. One map, no shuffle."""

    def make():
        if model:
            marks = model["marks"].astype(np.float32)

        def f(b):
            texts = b.column(2).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if model and t and _has_letter(t)]
            for part in batches(at):
                s = _kernel(presence([_fold(texts[i]) for i in part], BITS, ORDERS), marks, model["norms"]) @ model["weights"] + model["bias"]
                e = np.exp(3.0 * (s - s.max(1, keepdims=True)))
                best = s.argmax(1)
                for i, k, p in zip(part, best.tolist(), (e[np.arange(len(part)), best] / e.sum(1)).tolist()):
                    lang[i], score[i] = model["langs"][k], p
            return [b.column(0), b.column(1), lang, score]

        return f

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), "doc_id long, held_out boolean, lang_pred string, score double", make)
