"""Operator 4: toxicity by noisy-channel deobfuscation.

A word that looks written around a filter (symbols or digits among letters, separators between single
letters, doubled letters or longer runs) spans a character lattice: each symbol may stand for letters, a
separator may stand for nothing or a word boundary, a repetition for one letter or two (a run of one character
counts as three at most, in words of any length). Accented letters stand for themselves and for their base letters, in
words of letters too. Blanks are read as separators in two places: between single characters, from two on, and
between fragments that a lexicon word falls into. A Viterbi search under a
trigram character model finds the likeliest word. The restored text is then scored by a logistic
model over a lexicon learned from the labels.

* The character model counts trigrams over all documents, and the lexicon's words with a weight.
* The lexicon are the words and stems whose document counts in the classes differ most, from at most ``rows``
  learnable labelled rows (the bound of the sample, and so of the lexicon; of a repeated id its least text).

Defined cases: null text is empty; an empty text has the score of a text without a lexicon word; with
no labels the score is 0.5 minus a margin for all; of equally likely spellings the first in order is read;
repeated ids are scored row by row; very long texts are read whole; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, held_out, lean, map_batches, map_rows, slices, text_sample
from .shingles import in_batches

#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h", "*": "aeiou", "%": "aeiou"}
SEPARATORS = ".-_*~'^/\\,+:;·"
_A = 27  # letters and the word boundary
_EDGE = re.compile(r"^[^\w@$!|(*€£#]+|[^\w@$|(*€£#]+$")
_LETTERS = re.compile(r"[^\W\d_]+\Z")
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE_OR_MORE = re.compile(r"(.)\1{2,}")
_SPLIT = re.compile(r"[^\w]+")
_PARTS = re.compile(f"[{re.escape(SEPARATORS)}]+")
_SINGLE = str.maketrans({sign: letters for sign, letters in SIGNS.items() if len(letters) == 1} | {"1": "i", "!": "i", "|": "i"} | dict.fromkeys(SEPARATORS, ""))
STEMS = (4, 5, 6)  # a word's beginnings of these lengths count too, for inflected words


def _codes(text: str) -> np.ndarray:
    """a to z as 1 to 26, all else 0."""
    a = np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.int32) | 32
    return np.where((a >= 97) & (a <= 122), a - 96, 0)


def char_counts(docs: DataFrame) -> np.ndarray:
    """float[27, 27, 27]: trigram counts over all rows of documents; each task adds its own up first."""

    def run(batches):
        import pyarrow as pa

        lean()
        total = np.zeros(_A**3, np.int64)
        for b in (x for whole in batches for x in slices(whole)):
            texts = [t or "" for t in b.column(0).to_pylist()]
            for a, z in in_batches(texts):
                c = _codes(" " + " ".join(texts[a:z]) + "  ")
                total += np.bincount(c[:-2] * (_A * _A) + c[1:-1] * _A + c[2:], minlength=_A**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["k", "n"])
        give_back()

    got = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_A**3)
    out[got.k.to_numpy(np.int64)] = got.n
    return out.reshape(_A, _A, _A)


class Channel:
    """The trigram model and the Viterbi search."""

    def __init__(self, counts: np.ndarray, words: list[str] = (), weight: float = 0.25):
        c = counts.astype(np.float64).copy()
        mass = max(counts.sum(), 1000.0)
        spoken = [w for w in words if w.isascii() and w.isalpha()]
        for w in spoken:
            k = np.concatenate(([0], _codes(w), [0, 0]))
            np.add.at(c, (k[:-2], k[1:-1], k[2:]), weight * mass / max(1, len(spoken)) / len(k))
        two = c.sum(2)
        one = two.sum(1)
        p1 = (one + 1) / (one.sum() + _A)
        p2 = (two + 5 * p1[None, :]) / (two.sum(1, keepdims=True) + 5)
        p3 = (c + 5 * p2[None, :, :]) / (c.sum(2, keepdims=True) + 5)
        self.p = np.log(p3).tolist()
        self.first = np.log(p2).tolist()

    def decode(self, word: str, apart: bool = False) -> str:
        """The likeliest plain word behind `word` (lower case); with `apart` the likeliest words, as every separator
        or blank may be a word boundary too. Letters outside a to z stand for themselves."""
        beam: dict = {(0, 0): (0.0, None)}  # last two letters -> cost and spelling, last letter first
        last, often = "", len(_DOUBLE.findall(word)) > 1
        for ch in word:
            options = []
            between = ch in SEPARATORS or ch == " "
            if ch.isalpha():
                options.append((0.0, ch))
            else:
                options += [(1.0 if len(SIGNS.get(ch, "")) == 1 else 1.6, x) for x in SIGNS.get(ch, "")]
                if between or not options:
                    options.append((0.7 if between else 3.0, ""))
            if ch == last:
                options.append((0.4 if often or ch * 3 in word else 2.0, ""))
            last = ch if not between else last
            new: dict = {}
            for (a, b), (cost, out) in beam.items():
                for price, x in options:
                    if x:
                        k = ord(x) - 96 if "a" <= x <= "z" else 0
                        to, total = (b, k), cost + price - (self.p[a][b][k] if a or b else self.first[0][k])
                    else:
                        to, total = (a, b), cost + price
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (x, out) if x else out)
                if apart and between and out and out[0] != " ":
                    total = cost + 0.7 - self.p[a][b][0]
                    if (0, 0) not in new or total < new[0, 0][0]:
                        new[0, 0] = (total, (" ", out))
            beam = new

        def spelled(out) -> str:
            letters = []
            while out:
                letters.append(out[0])
                out = out[1]
            return "".join(reversed(letters))

        ends = [(cost - self.p[a][b][0], out) for (a, b), (cost, out) in beam.items()]
        least = min(cost for cost, _ in ends)
        return min(spelled(out) for cost, out in ends if cost == least)


def _base_letters(word: str) -> str:
    """Accented letters as their base letters."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _restored(piece: str, channel: Channel) -> list[str]:
    """What one piece without its edges may stand for, also without the signs around it."""
    piece = _TRIPLE_OR_MORE.sub(r"\1\1\1", piece)
    found = []
    for core in dict.fromkeys((piece, _base_letters(piece))):
        found.append(channel.decode(core))
        bare = _EDGE.sub("", core.strip("!*#$|(@€£"))
        if bare != core and bare:
            found.append(bare if _LETTERS.match(bare) and not _DOUBLE.search(bare) else channel.decode(bare))
        if _PARTS.search(core):
            found += channel.decode(core, apart=True).split()
    return found


def _unmasked(core: str) -> bool:
    """Whether a token without its edges is of letters, none of them doubled: nothing in it is to be decoded."""
    return bool(_LETTERS.match(core)) and not _DOUBLE.search(core)


def plain_words(token: str, channel: Channel | None) -> tuple[str, ...]:
    """The words that one white-space-delimited lower-case token stands for."""
    core = _EDGE.sub("", token)
    if not core:
        return ()
    if _LETTERS.match(core) and not (channel and _DOUBLE.search(core)):
        return (core,)
    found = [w for w in _SPLIT.split(core) if w]
    if channel:
        for piece in dict.fromkeys([core, *found, *_PARTS.split(core)]):
            if piece == core or len(piece) > 1 and not (_LETTERS.match(piece) and not _DOUBLE.search(piece)):
                found += _restored(piece, channel)
    return tuple(dict.fromkeys(w for w in found if w))


def with_stems(words) -> list[str]:
    """Words, and their beginnings marked by ^."""
    return [*words, *("^" + w[:n] for w in words for n in STEMS if len(w) > n)]


def spaced(tokens: list[str], channel_of) -> list[str]:
    """Words spelled with a blank between their letters: a run as one word, and as the likeliest words.
    channel_of(letters): the channel to read them by, or None."""
    out, run = [], []
    for t in [*tokens, "  "]:
        if len(t) == 1:
            run.append(t)
        else:
            channel = channel_of(" ".join(run)) if len(run) > 1 else None
            if channel is not None:
                out += [channel.decode("".join(run)), *channel.decode(" ".join(run), apart=True).split()]
            run = []
    return list(dict.fromkeys(w for w in out if w))


class Speller:
    """Tells which tokens could spell one of the lexicon's words or beginnings, whatever the lattice's prices: from the
    beginning of the token, or after a sign, its letters one after another, where a sign may stand for one of its letters
    or for nothing, and a letter said again for nothing. Words are held as a tree; a token is read once."""

    def __init__(self, lexicon):
        self.root: dict = {}
        for w in lexicon:
            node = self.root
            for c in _base_letters(w.removeprefix("^")):
                node = node.setdefault(c, {})
            node["^" if w[:1] == "^" else ""] = True

    def could(self, token: str) -> bool:
        states: list[dict] = []
        fresh, last = True, ""
        for ch in _base_letters(token):
            if ch.isalpha():
                more = [n[ch] for n in states if ch in n]
                if fresh and ch in self.root:
                    more.append(self.root[ch])
                if ch == last:
                    more += states
                fresh, last = False, ch
            else:
                if any("" in n for n in states):
                    return True
                more = list(states)
                for x in SIGNS.get(ch, ""):
                    more += [n[x] for n in states if x in n]
                    if fresh and x in self.root:
                        more.append(self.root[x])
                fresh = True
            states = list({id(n): n for n in more}.values()) if len(more) > 1 else more
            if any("^" in n for n in states):
                return True
        return any("" in n for n in states)


_NOTHING: tuple = ((), "")


class Reader:
    """Restored words of texts, with a memory of at most `most` tokens seen, of 64 characters or fewer each."""

    def __init__(self, channel: Channel | None, lexicon: dict[str, int] | None, most: int = 150_000):
        self.channel, self.lexicon, self.most, self.seen = channel, lexicon, most, {}
        self.speller = Speller(lexicon) if lexicon else None
        marks = [(x[:1] == "^", _base_letters(x.removeprefix("^"))) for x in lexicon or ()]
        self.whole, self.stems = ({w for is_stem, w in marks if is_stem == k} for k in (False, True))
        self.starts = {w[:k] for _, w in marks for k in range(1, len(w))}
        self.opens = {w[:k] for _, w in marks for k in (1, 2, 3)}
        self.roots = {w[1 : 1 + STEMS[0]] for w in lexicon or () if w[:1] == "^"}

    def _channel(self, token: str) -> Channel | None:
        """The channel, where the token could spell what the lexicon holds; decoding another would find nothing in it."""
        if self.channel is None or self.lexicon is None:
            return self.channel
        return self.channel if self.speller is not None and self.speller.could(token) else None

    def _spelled(self, token: str) -> str:
        """A fragment by its letters, where each sign can be but one."""
        return token if token.isascii() and token.isalpha() else _base_letters(token).translate(_SINGLE)

    def broken(self, tokens: list[str], heads: dict[str, str]) -> list[str]:
        """The likeliest words in fragments, standing side by side, that join to a lexicon word or to one with its
        beginning; heads: how the tokens that such a word may begin with are spelled."""
        out: list[str] = []
        for i, t in enumerate(tokens):
            if t in heads:
                joined, j = heads[t], i + 1
                while j < len(tokens):
                    joined += self._spelled(tokens[j])
                    j += 1
                    if joined[:3] not in self.opens:
                        break
                    if joined in self.whole or any(joined[:n] in self.stems for n in STEMS if len(joined) > n):
                        said = " ".join(tokens[i:j])
                        for form in dict.fromkeys((said, _base_letters(said))):
                            out += self.channel.decode(form, apart=True).split()
                    if joined not in self.starts:
                        break
        return out

    def _numbers(self, words) -> tuple[int, ...]:
        """The numbers of the lexicon's words and beginnings among words and their beginnings."""
        lexicon, found = self.lexicon, []
        for w in words:
            if w in lexicon:
                found.append(lexicon[w])
            if w[:STEMS[0]] in self.roots:
                found += [lexicon["^" + w[:n]] for n in STEMS if len(w) > n and "^" + w[:n] in lexicon]
        return tuple(dict.fromkeys(found))

    def _read(self, token: str):
        """(restored words or their numbers, how the token is spelled if a lexicon word may begin with it)."""
        core = token if token.isalpha() else _EDGE.sub("", token)
        if core.isalpha() and (self.channel is None or not _DOUBLE.search(core) or self._channel(core) is None):
            words = (core,) if self.channel is None or core.isascii() else tuple(dict.fromkeys((core, _base_letters(core))))
            head = words[-1]
        else:
            words = plain_words(token, self._channel(token))
            head = self._spelled(token) if self.channel is not None else ""
        if self.lexicon is None:
            return with_stems(words), ""
        found, head = self._numbers(words), head if head in self.starts else ""
        return (found, head) if found or head else _NOTHING

    def words(self, text: str) -> set:
        """All restored words and stems; with a lexicon, the numbers of those in it."""
        tokens = text.lower().split()
        seen, out, heads = self.seen, set(), {}
        for t in set(tokens):
            known = seen.get(t)
            if known is None:
                known = self._read(t)
                if len(t) <= 64:
                    if len(seen) >= self.most:
                        seen.clear()
                    seen[t] = known
            if known[0]:
                out.update(known[0])
            if known[1]:
                heads[t] = known[1]
        if self.channel is not None:
            extra = spaced(tokens, self._channel) + (self.broken(tokens, heads) if heads else [])
            out.update(with_stems(extra) if self.lexicon is None else self._numbers(extra))
        return out


def _reader(model: dict) -> Reader:
    return Reader(Channel(model["counts"], model["lexicon"]), {w: i for i, w in enumerate(model["lexicon"])})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8_000, least: int = 6, z: float = 5.0) -> dict:
    """{lexicon, weights, bias, counts}"""
    chosen = text_sample(docs, labels, label, rows).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))

    def make():
        reader = Reader(None, None)

        def f(b):
            return [b.column(0), b.column(1), [sorted(reader.words(t)) for t in b.column(2).to_pylist()]]

        return f

    words = map_batches(chosen, "doc_id long, label int, words array<string>", make)
    size = chosen.groupBy("label").count().toPandas().set_index("label")["count"].to_dict()
    n1, n0 = size.get(1, 0), size.get(0, 0)
    counts = char_counts(docs)
    if not n1 or not n0:
        return {"lexicon": [], "weights": np.zeros(0), "bias": math.log((n1 + 0.5) / (n0 + 1.0)) if n1 + n0 else -0.1, "counts": counts}
    by_word = words.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    p, q = (F.col("n1") / n1), (F.col("n0") / n0)
    pool = (F.col("n1") + F.col("n0")) / (n1 + n0)
    far = (p - q) / F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0) + 1e-12)
    top = by_word.where((F.col("n1") >= least) & (p > 4 * q)).withColumn("z", far).where(F.col("z") >= z).orderBy(F.desc("z"), "word").toPandas()
    lexicon = top.word.tolist()
    if not lexicon:
        return {"lexicon": [], "weights": np.zeros(0), "bias": math.log((n1 + 0.5) / (n0 + 0.5)), "counts": counts}
    no = {w: i for i, w in enumerate(lexicon)}

    def numbered():
        reader = Reader(None, no)

        def f(b):
            return [b.column(1), [sorted(reader.words(t)) for t in b.column(2).to_pylist()]]

        return f

    got = map_batches(chosen, "label int, w array<int>", numbered).groupBy("label", "w").count().toPandas()
    x, y, n = np.zeros((len(got), len(lexicon) + 1)), got.label.to_numpy(float), got["count"].to_numpy(float)
    x[:, -1] = 1
    for i, ws in enumerate(got.w):
        x[i, ws] = 1
    beta = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], 0.2)
    pull[-1] = 1e-3
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (n * mu * (1 - mu) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (n * (y - mu)) - pull * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return {"lexicon": lexicon, "weights": beta[:-1], "bias": float(beta[-1]), "counts": counts}


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, words): words are the lexicon's words in the restored text. One map, no shuffle."""
    lexicon = model["lexicon"]

    def make():
        reader = _reader(model)
        weights, bias = model["weights"].tolist(), model["bias"]

        def f(b):
            out, words = [], []
            for t in b.column(2).to_pylist():
                hit = sorted(reader.words(t)) if t else []
                m = bias + sum(weights[k] for k in hit)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m)))))
                words.append([lexicon[k] for k in hit])
            return [b.column(0), b.column(1), out, [int(s >= threshold) for s in out], words]

        return f

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), "doc_id long, held_out boolean, score double, predicted int, words array<string>", make)


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, unchanged, whose score is below the threshold. One map, no shuffle."""
    at = docs.columns.index("text")
    width = len(docs.columns)

    def make():
        import pyarrow as pa

        reader = _reader(model)
        weights, most = model["weights"].tolist(), math.log(threshold / (1 - threshold)) - model["bias"]

        def f(b):
            clean = pa.array([sum(weights[k] for k in reader.words(t or "")) < most for t in b.column(at).to_pylist()])
            kept = b.filter(clean)
            return [kept.column(i) for i in range(width)] if kept.num_rows else None

        return f

    return map_rows(docs, make)
