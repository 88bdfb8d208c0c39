"""Operator 5: a quality classifier with naive Bayes features and a linear support vector machine.

Features are indicators of character n-grams (orders 1 to 3, case kept, hashed) and of runs of equal
neighbouring words (an n-gram of repetition marks for each length up to ``RUNS``). Each indicator is
scaled by the log ratio of its smoothed class frequencies, and a linear model is fitted to the hinge
loss by dual coordinate descent. The score is the logistic function of the margin.

The repetition marks are there because the commonest fault of a bad text, one word again and again, is
an n-gram of any words, which no n-gram of given characters stands for.

Labels are learned from at most ``rows`` learnable rows (by a hash of the id; of a repeated id its least
text). Every text is scored whole, very long ones in pieces that overlap. Defined cases: null text is empty; empty texts have a score like any other; without rows to
learn from, or with one class only, the score is the share of class 1 (0.5 without rows); repeated ids
are scored row by row, and equal texts have equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out, map_batches, text_sample
from .ngrams import batches, presence

BITS, ORDERS, RUNS = 14, (1, 2, 3), 8


def indicators(texts: list[str]) -> np.ndarray:
    """bool[len(texts), 2**BITS + RUNS]"""
    out = np.zeros((len(texts), (1 << BITS) + RUNS), bool)
    out[:, : 1 << BITS] = presence(texts, BITS, ORDERS)
    for i, t in enumerate(texts):
        w = t.lower().split()
        if len(w) > 1:
            same = np.fromiter(map(str.__eq__, w, w[1:]), bool, len(w) - 1)
            if same.any():
                edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                out[i, (1 << BITS) : (1 << BITS) + min(RUNS, int((edge[1::2] - edge[::2]).max()))] = True
    return out


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + c * sum of hinge losses; a row is its indicators' positions."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            at, v = rows[i], values[i]
            step = (1.0 - y[i] * (w[at] @ v + bias)) / square[i]
            new = min(max(alpha[i] + step, 0.0), c)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[at] += d * v
                bias += d
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6000, c: float = 0.05, epochs: int = 12) -> dict:
    chosen = text_sample(docs, labels, label, rows).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))

    def make():
        def f(b):
            bits = []
            for part in batches(b.column(2).to_pylist()):
                bits += [x.tobytes() for x in np.packbits(indicators(part), axis=1)]
            return [b.column(0), b.column(1), bits]

        return f

    got = map_batches(chosen, "doc_id long, label int, bits binary", make).toPandas().sort_values(["doc_id", "label"], kind="stable")
    y = np.where(got.label.to_numpy() == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return {"constant": float((y == 1).mean()) if len(y) else 0.5}
    width = (1 << BITS) + RUNS
    at = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))[:width]).astype(np.int32) for x in got.bits]
    one, zero = np.ones(width), np.ones(width)
    for r, k in zip(at, y):
        (one if k > 0 else zero)[r] += 1
    scale = np.log((one / ((y > 0).sum() + 2)) / (zero / ((y < 0).sum() + 2)))
    w, bias = dual_coordinate_descent(at, scale, y, c, epochs)
    return {"weights": (w * scale).astype(np.float32), "bias": bias}


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted). One map over the rows, no shuffle."""

    def make():
        def f(b):
            out = []
            for part in batches([t or "" for t in b.column(2).to_pylist()]):
                if "constant" in model:
                    out += [model["constant"]] * len(part)
                else:
                    m = indicators(part).astype(np.float32) @ model["weights"] + model["bias"]
                    out += (1 / (1 + np.exp(-np.clip(3.0 * m.astype(np.float64), -30, 30)))).tolist()
            return [b.column(0), b.column(1), out, [int(s >= threshold) for s in out]]

        return f

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), "doc_id long, held_out boolean, score double, predicted int", make)
