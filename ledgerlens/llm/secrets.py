"""Operator 7: secret scans by base patterns and a character Markov likelihood ratio.

Base kinds (assign, access, hex) are fixed patterns. The method adds spans of kind ``markov``: unbroken tokens of
``MIN_TOKEN`` characters or more that are likelier under a Markov model of random strings than under one of ordinary
identifiers. Each model has two chains: one of the kinds of characters (lower case, capital, digit, sign), and one of the
letters, which starts anew with every word of an identifier (after a sign or a digit, and at a capital after a small letter).

* The models of random strings, one for each alphabet that keys use, are trained on strings drawn with a fixed seed.
* The model of ordinary identifiers is trained on labelled samples, composed of the words listed here and of words of the
  corpus (tokens too short for a secret; at most ``words`` of them, those with the smallest hashes); its letters
  moreover on all tokens of the corpus too short for a secret, so it knows the languages that the corpus is written in.
* The score is the mean log-likelihood ratio of a character, under the likeliest random model. The threshold lies where
  ``RECALL`` of the random strings that no model learned from score higher, and above all ordinary identifiers that no
  model learned from. A span must hold ``LEAST_DIFFERENT`` different characters.

Defined cases: null text is empty; a row with no span has zero counts, the digest of the empty
string and empty spans; a token that overlaps a base span is part of it; a rule of equal signs is no secret; repeated rows
and null ids are scanned like any other; very long texts are scanned in one pass over their bytes, and a very long token
like any; an empty table gives no rows, and models of the words listed here alone; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, lean, map_batches, map_rows, ship, slices

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_CODE = np.full(256, -1, np.int16)
for _i, _c in enumerate(_ALNUM + "+/_-="):
    _CODE[ord(_c)] = _i
_IS_HEX, _IS_TOKEN = np.zeros(256, bool), _CODE >= 0
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
MIN_TOKEN, LEAST_DIFFERENT, RECALL = 20, 8, 0.995
_LOWER, _UPPER, _DIGIT, _SIGN, _START = range(5)
_KIND = np.full(256, _SIGN, np.int8)
_LETTER = np.zeros(256, np.int64)  # 1 to 26 for a letter of either case
for _i in range(26):
    _KIND[97 + _i], _KIND[65 + _i] = _LOWER, _UPPER
    _LETTER[97 + _i] = _LETTER[65 + _i] = _i + 1
_KIND[48:58] = _DIGIT
_WORDS_ONLY = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 else 32 for i in range(256))
ALPHABETS = (_ALNUM, _ALNUM + "+/", _ALNUM + "_-", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _ALNUM[:52], _ALNUM[26:])
SIGNS = "+/_-="
ROWS = ("abcdefghijklmnopqrstuvwxyz", "qwertyuiop", "asdfghjkl", "zxcvbnm", "0123456789")  # written out, they are no secret

#: Ordinary words of which identifiers are composed, where the corpus has none.
PARTS = """
account action active address admin align alpha amount array async attribute author average backup balance banner
base before block body border bottom branch buffer build button cache callback cancel category center change channel
character chart check child class clean click client clock close cluster code collection color column command comment
commit common compare complete component config connection constant container content context control convert copy count
country create current customer daily data database date debug default delete delivery depth detail device directory
display distance document domain download driver dynamic edit element email empty enable encode engine entry error event
example execute expand export factory failure feature field file filter final first flag font footer form format forward
function gateway general global graph group handler hash header health height helper hidden history host image import
index info initial inner input insert install instance integer interface internal invoice item iterator join keyboard
language last layer layout length level library license limit line link list loader local location logger login machine
""".split()
PROSE = """
aber anderen arbeit aufgabe bericht dampf deutsche donau einheit entwicklung fahrt fleisch freundschaft gesellschaft gesetz
haus jahr kapitän kraft recht rind schiff schutz straße übertragung überwachung verordnung versicherung verwaltung wirtschaft
administration année aujourd bonjour bureau développement exemple français gouvernement heure jour maison maintenant
monsieur nouveau ouvrage paysage politique pourquoi quelque rendez société toujours travail vous
administración ahora ciudad corazón cuando desarrollo ejemplo entonces español gobierno hombre información mañana
mundo nuevo palabra porque pueblo siempre sociedad también trabajo universidad usuario verdad
could every great house little never nothing people question should thing through together where which world would
kubernetes node pool production staging region west east north south central server service cloud network python spark
""".split()


def letter_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of bytes' letters with the two before them in their word, as one number; whether a byte is a letter)."""
    letter, kind = _LETTER[data], _KIND[data]
    new = np.ones(len(data), bool)  # a word begins here
    new[1:] = (letter[:-1] == 0) | ((kind[1:] == _UPPER) & (kind[:-1] == _LOWER))
    one, two = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    one[1:] = np.where(new[1:], 0, letter[:-1])
    two[2:] = np.where(new[2:] | new[1:-1], 0, letter[:-2])
    return two * 729 + one * 27 + letter, letter > 0


class Chains:
    """Log-likelihoods of tokens, given as bytes, under chains of kinds and of letters."""

    def __init__(self, samples: list[str], letters: np.ndarray | None = None):
        kinds, own = np.full((5, 4), 0.05), np.zeros(27**3)
        signs, same = np.full(256, 0.02), np.array([1.0, 1.0])  # signs as such, and how often one repeats the sign before it
        digits = np.zeros(256)
        digits[48:58] = 0.5
        for x in samples:
            data = np.frombuffer(x.encode(), np.uint8)
            k = _KIND[data]
            np.add.at(kinds, (np.concatenate(([_START], k[:-1])), k), 1)
            code, is_letter = letter_codes(data)
            own += np.bincount(code[is_letter], minlength=27**3)
            signs += np.bincount(data[k == _SIGN], minlength=256)
            digits += np.bincount(data[k == _DIGIT], minlength=256)
            two = (k[1:] == _SIGN) & (k[:-1] == _SIGN)
            same += (int((two & (data[1:] == data[:-1])).sum()), int((two & (data[1:] != data[:-1])).sum()))
        if letters is not None and letters.sum():
            own = letters + own * max(1.0, 0.2 * letters.sum() / max(own.sum(), 1))
        c = own.reshape(27, 27, 27)[:, :, 1:]
        two = c.sum(0)
        one = (two.sum(0) + 0.5) / (two.sum() + 13)
        p2 = (two + 4 * one) / (two.sum(1, keepdims=True) + 4)
        p3 = (c + 4 * p2) / (c.sum(2, keepdims=True) + 4)
        self.letters = np.concatenate((np.zeros((27, 27, 1)), np.log(p3)), axis=2).ravel()
        self.kinds = np.log(kinds / kinds.sum(1, keepdims=True))
        self.other = np.zeros(256)
        self.other[list(map(ord, SIGNS))] = np.log(signs / signs[list(map(ord, SIGNS))].sum())[list(map(ord, SIGNS))]
        self.other[48:58] = np.log(digits[48:58] / digits[48:58].sum())
        self.same = np.log(same / same.sum())

    def score(self, data: np.ndarray) -> float:
        k = _KIND[data]
        code, is_letter = letter_codes(data)
        total = self.kinds[_START, k[0]] + self.kinds[k[:-1], k[1:]].sum() + self.letters[code[is_letter]].sum()
        two = np.concatenate(([False], (k[1:] == _SIGN) & (k[:-1] == _SIGN)))
        again = two & np.concatenate(([False], data[1:] == data[:-1]))
        plain = ~is_letter & ~again
        return float(total + self.other[data[plain]].sum() + again.sum() * self.same[0] + (two & ~again).sum() * self.same[1])


def random_strings(n: int = 600, seed: int = 11) -> list[list[str]]:
    """For each alphabet, n random strings."""
    r = random.Random(seed)
    return [["".join(r.choices(a, k=r.randint(20, 48))) for _ in range(n)] for a in ALPHABETS]


def identifiers(words: list[str], n: int = 3000, seed: int = 11) -> list[str]:
    """n ordinary identifiers of the given words and of PARTS and PROSE: joined by signs, in camel case, run together."""
    r = random.Random(seed)
    given = [w for w in words if w.isascii() and w.isalpha()] or PARTS
    plain = [w for w in PARTS + PROSE if w.isascii()]
    joins, out = ("_", "-", "", "/", "__", "-", "+", "="), []
    for i in range(n):
        parts = [r.choice(given if r.random() < 0.5 else plain) for _ in range(r.randint(2, 7))]
        if i % 25 == 0:
            parts = list(r.sample(ROWS, 3))
        if i % 3 == 0:
            parts = [p.capitalize() for p in parts]
        elif i % 7 == 0:
            parts = [p.upper() for p in parts]
        if i % 5 == 0:
            parts.insert(r.randint(1, len(parts)), str(r.randint(0, 2030)))
        out.append(joins[i % 8].join(parts)[:64] + ("=" * r.randint(2, 30) if i % 40 == 0 else "-" * r.randint(2, 30) if i % 40 == 20 else ""))
    return out


def learn(letters: np.ndarray | None = None, words: list[str] = (), margin: float = 0.05, seed: int = 11) -> tuple[list[Chains], Chains, float]:
    """(models of random strings, model of ordinary identifiers, threshold)."""
    plain, rand = identifiers(list(words), seed=seed), random_strings(seed=seed)
    model = ([Chains(x[::2]) for x in rand], Chains(plain[::2], letters), 0.0)
    score = lambda x: ratio(model, np.frombuffer(x.encode(), np.uint8))
    worst = max(score(x) for x in plain[1::2] if len(x) >= MIN_TOKEN)
    usual = float(np.quantile([score(x) for xs in rand for x in xs[1::2]], 1 - RECALL))
    return model[0], model[1], max(worst + margin, usual)


def ratio(model: tuple[list[Chains], Chains, float], token: np.ndarray) -> float:
    """The mean log-likelihood ratio of a character; of a token without variety minus infinity."""
    if len(set(token.tolist())) < LEAST_DIFFERENT:
        return float("-inf")
    return (max(m.score(token) for m in model[0]) - model[1].score(token)) / len(token)


def fit(docs: DataFrame, words: int = 2_000) -> tuple[list[Chains], Chains, float]:
    """The models for a corpus: letters of all its tokens too short for a secret are counted, each task adding up its own;
    `words` bounds the words of the corpus that identifiers are composed of."""
    ship(docs.sparkSession)

    def run(batches):
        lean()
        total, least = np.zeros(27**3, np.int64), set()
        for b in (x for whole in batches for x in slices(whole, 250_000)):
            texts = [t.encode() for t in b.column(0).to_pylist() if t]
            if not texts:
                continue
            data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
            flags = _IS_TOKEN[data]
            for a, z in zip(*(x.tolist() for x in _runs(flags, MIN_TOKEN))):
                flags[a:z] = False  # what may be a secret teaches nothing
            short = np.where(flags, data, 0).astype(np.uint8)
            code, is_letter = letter_codes(short)
            total += np.bincount(code[is_letter], minlength=27**3)
            least = set(sorted(least | {(zlib.crc32(w), w) for w in set(short.tobytes().translate(_WORDS_ONLY).split()) if 3 <= len(w) <= 15})[:words])
        some = np.flatnonzero(total)
        rows = [(-1, str(k), n) for k, n in zip(some.tolist(), total[some].tolist())] + [(h, w.decode(), 0) for h, w in least]
        h, w, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["h", "w", "n"])
        give_back()

    found = docs.select("text").mapInArrow(run, "h long, w string, n long").groupBy("h", "w").agg(F.sum("n").alias("n"))
    letters, given = np.zeros(27**3), []
    for r in found.orderBy("h", "w").limit(27**3 + words).collect():  # letters come first
        if r.h < 0:
            letters[int(r.w)] = r.n
        elif len(given) < words:
            given.append(r.w)
    return learn(letters, given)


def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    a, z = edge[::2], edge[1::2]
    keep = z - a >= least
    return a[keep], z[keep]


def spans_of_all(texts: list[str], model: tuple[list[Chains], Chains, float]) -> list[list[tuple[int, int, int]]]:
    """For each text its sorted spans (start, kind index, end), in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, t in enumerate(texts):
        if "AKIA" in t:
            out[i] += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 18]
        if "=" in t or ":" in t:
            low = t.lower()
            if any(w in low for w in _WORDS):
                out[i] += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw])
    starts = ends - [len(x) + 1 for x in raw]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point that each byte belongs to

    def place(a: np.ndarray, z: np.ndarray):
        """(text, first code point, end) of runs of bytes."""
        i = np.searchsorted(ends, a, "right")
        first = point[a] - point[starts[i]]
        return zip(i.tolist(), first.tolist(), (first + z - a).tolist())

    for i, s, e in place(*_runs(_IS_HEX[data], 16)):
        out[i].append((s, 2, e))
    for x in out:
        x.sort()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    a, z = _runs(_IS_TOKEN[data], MIN_TOKEN)
    likely = np.array([ratio(model, data[x:y]) >= model[2] for x, y in zip(a.tolist(), z.tolist())], bool)
    covered = [0] * len(texts)  # how many base spans begin before the token at hand, and the furthest end of these
    reach = [0] * len(texts)
    for i, s, e in place(a[likely], z[likely]):
        base = out[i]
        while covered[i] < len(base) and base[covered[i]][0] < e:
            reach[i] = max(reach[i], base[covered[i]][2])
            covered[i] += 1
        if reach[i] <= s:
            found[i].append((s, 3, e))
    for x, more in zip(out, found):
        if more:
            x += more
            x.sort()
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for each row of documents. One map over the rows;
    without a model, one before it, that fits it to them."""
    model = model or fit(docs)

    def make():
        def f(b):
            found = spans_of_all([t or "" for t in b.column(1).to_pylist()], model)
            base = [[x for x in s if x[1] < 3] for s in found]
            count = [[sum(x[1] == k for x in s) for s in found] for k in range(4)]
            return [b.column(0), *count, [hashlib.sha256(_join(s).encode()).hexdigest() for s in base], [_join(s) for s in found]]

        return f

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string", make)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", model: tuple | None = None) -> DataFrame:
    """The rows of documents with every span replaced by `mark` and n_chars counted anew; no row goes."""
    names = docs.columns
    at, n = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    model = model or fit(docs)

    def make():
        def f(b):
            texts = b.column(at).to_pylist()
            cols = [b.column(i) for i in range(len(names))]
            found = spans_of_all([t or "" for t in texts], model)
            for i, spans in enumerate(found):
                if spans:
                    out, last = [], 0
                    for s, _, e in spans:
                        if s >= last:
                            out += [texts[i][last:s], mark]
                        last = max(last, e)
                    texts[i] = "".join(out) + texts[i][last:]
            cols[at] = texts
            if n >= 0:
                was = cols[n].to_pylist()
                cols[n] = [len(texts[i]) if found[i] else was[i] for i in range(len(texts))]
            return cols

        return f

    return map_rows(docs, make)
