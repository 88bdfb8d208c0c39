"""Presence of blended character n-grams, by numpy over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20  # code points looked at together


def _parts(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Texts in order; a long one as pieces that overlap by three characters."""
    for i, t in enumerate(texts):
        if len(t) <= _PIECE:
            yield i, t
        else:
            for a in range(0, len(t), _PIECE - 3):
                yield i, t[a : a + _PIECE]


def _mark(flags: np.ndarray, group: list[tuple[int, str]], bits: int, orders: tuple[int, ...]) -> None:
    lens = np.array([len(t) for _, t in group])
    chars = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(group)), lens)
    base = np.repeat(np.array([i for i, _ in group]), lens).astype(np.int64) << bits
    shift, key = np.uint64(64 - bits), chars.copy()
    flat = flags.reshape(-1)
    for n in range(1, max(orders) + 1):
        if n > 1:
            key = (key[:-1] << np.uint64(21)) ^ (key[:-1] >> np.uint64(43)) ^ chars[n - 1 :]
        if n in orders and len(key):
            h = (((key + np.uint64(n)) * _ODD) >> shift).astype(np.int64)
            h += base[: len(h)]
            flat[h[row[: len(h)] == row[n - 1 :]] if n > 1 else h] = True


def presence(texts: list[str], bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """bool[len(texts), 2**bits]: which hashed n-grams of the given orders a text holds, over the whole text."""
    flags = np.zeros((len(texts), 1 << bits), bool)
    group, size = [], 0
    for part in _parts(texts):
        group.append(part)
        size += len(part[1])
        if size >= _PIECE:
            _mark(flags, group, bits, orders)
            group, size = [], 0
    if group:
        _mark(flags, group, bits, orders)
    return flags


def batches(texts: list[str], rows: int = 256) -> Iterator[list[str]]:
    for i in range(0, len(texts), rows):
        yield texts[i : i + rows]
