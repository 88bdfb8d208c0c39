"""Sets of hashed word shingles, by numpy over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_r = np.random.default_rng(20240607)
_BYTE = _r.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_WORD = _r.integers(1, 2**63, 8, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []
PIECE = 250_000  # characters of texts looked at together


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_STEP, _BACK):
            a = np.full(max(n, PIECE + (1 << 16)), base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if n > 4 * PIECE:
            return out[0], out[1]  # of a very long text; not kept
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: list[bytes], apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text): words are what the bytes marked in `apart` leave (ASCII
    white space), A-Z as a-z."""
    joined = b" ".join(x.lower() for x in raw) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = apart[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    up, back = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(x) + 1 for x in raw])
    return h, np.searchsorted(stops, begin, "right")


def shingle_sets(texts: list[str], width: int = 4) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of `width` words as uint64; with fewer words the whole
    sequence is one; no words: empty."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append((t or "").encode())
        size += len(group[-1])
        if i == len(texts) - 1 or size > PIECE:
            h, of = word_hashes(group)
            n = np.bincount(of, minlength=len(group))
            first = np.cumsum(n) - n
            if len(h) >= width:
                s = sum((h[i : len(h) - width + 1 + i] * _WORD[i] for i in range(width)), np.zeros(len(h) - width + 1, np.uint64))
                s = mix(s)
            for a, k in zip(first.tolist(), n.tolist()):
                if k >= width:
                    out.append(np.unique(s[a : a + k - width + 1]))
                elif k:
                    w = np.uint64(0)
                    for i in range(k):
                        w = np.uint64((int(w) + int(h[a + i]) * int(_WORD[i])) % 2**64)
                    out.append(mix(np.array([w], np.uint64) + np.uint64(k)))
                else:
                    out.append(np.zeros(0, np.uint64))
            group, size = [], 0
    return out


def in_batches(texts: list[str], chars: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
