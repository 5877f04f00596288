"""Toxicity by noisy-channel deobfuscation.

A token that someone may have disguised becomes a lattice: each sign may stand
for the letters it looks like, a run of one letter for one or two of them, and
single letters with blanks, dots or the like between them for words, however
long; beside these there is a path on which all signs stand for themselves. A
character language model, counted over the whole corpus, weighs the letters, a
channel charges for each change and for each sign that stands for itself, and
Viterbi's algorithm finds the likeliest reading, which may be the token as it
stands. What stands between single letters may be nothing or the end of a word,
so words that are spelled out one after the other are parted by the model. A plain token's lattice has one path, the token itself, so only texts
with a disguised place are touched. The restored text is then scored.

Letters of other scripts that look like Latin ones count as signs where they
stand in a word with Latin letters.

The score is a logistic regression on hashed features of the restored words:
whole words and their first bytes, by presence and by share of the text's
words. It is fitted on at most ``FIT_ROWS`` labelled texts of each class, those
with the smallest hash of their id, and calibrated on what models of most of
them say of the rest.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import _LOWER, FIRST, loads, mix, padded, slices, span_hashes, spans, text_bytes, trim
from .tokens import Encoder

U64 = np.uint64
#: Labelled texts of each class that the fit may use.
FIT_ROWS = 2000
#: Texts of each class from which on scores are calibrated; fewer do not tell what a model says of texts it has not seen.
CALIBRATED = 100
#: log2 of the number of hashed features; bytes of the prefixes.
FEATURE_BITS, PREFIXES = 18, (4, 6, 8)
#: Least score that counts as toxic.
CUT = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORD = _LETTER.copy()
_WORD[128:] = True

# -- the channel -------------------------------------------------------------

#: What a sign may stand for (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c"}
#: Letters of other scripts and the Latin ones they look like (fixed values).
ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_SIGNS, _LETTERS = "".join(LOOKS), "".join(ALIKE)
LOOKS |= ALIKE
#: What a change costs, what it costs for signs that are seldom letters, what a repeated letter and a word's end cost.
CHANGE, SELDOM, DROP, PART = 1.0, {"*": 1.5, "2": 3.0, "(": 6.0}, 0.3, 2.0
#: Words whose letters are less likely than this, on average, are none that the model knows; where such a word would come out, spelled letters are one word.
STRANGE = -4.0
#: Letters of a run that the language model counts, and how many counts the shorter runs weigh.
ORDER, SMOOTH = 4, 5.0
#: A run of signs that stands for itself: digits beside one or two letters, digits or a last ! at an edge of the token, other signs there, any within.
KEEP_COUNT, KEEP_EDGE, KEEP_SIGN, KEEP_INNER = -3.0, 0.5, 5.0, 7.0
#: Tokens whose reading a worker remembers before it starts afresh.
READINGS = 1 << 14

# tokens with a sign or three equal letters in a row; plain words are passed over without a call
_disguised = re.compile(r"(?<![a-z0-9@$|+])(?=[a-z]*+[0-9@$!|+*(]|[a-z]*?([a-z])\1\1)(?:[a-z0-9@$!|+]|(?<=[a-z0-9@$!|+])[*(](?=[a-z])){3,}(?![a-z0-9@$|+])", re.I | re.A)
_foreign = re.compile(rf"(?<!\w)(?=\w*[a-z])(?=\w*[{_LETTERS}])[a-z0-9@$!|+{_LETTERS}]{{3,}}(?!\w)", re.I)
_spaced = re.compile(rf"(?<![^\W_])(?:[A-Za-z{re.escape(_SIGNS)}]([ .*_-]))(?:[A-Za-z{re.escape(_SIGNS)}]\1)+[A-Za-z{re.escape(_SIGNS)}](?![^\W_])")
_repeat = re.compile(r"([a-z])\1\1")


def _spelled(way: tuple) -> str:
    """The letters along a way, which is the way before and its last letters; so a long token's readings share what they have in common."""
    out = []
    while way:
        way, letters = way
        out.append(letters)
    return "".join(reversed(out))


@dataclass
class CharModel:
    """Logarithms of the probabilities of a class after the classes before it, within a word: 0 boundary, 1-26 letters, 27 any other letter."""

    logs: np.ndarray

    def __post_init__(self):
        self.contexts = self.logs.size // 28
        self.forget()

    def forget(self) -> None:
        """Drops what a task makes of the model on its way; a worker that waits should not hold it."""
        self.table = array("f")
        self.known: dict[str, str] = {}

    def __getstate__(self):
        return {"logs": self.logs}

    def __setstate__(self, state):
        self.logs = state["logs"]
        self.__post_init__()

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        """From the counts of all runs of classes of one length; each length is smoothed by the one below."""
        order = round(math.log(counts.size, 28))
        c = counts.reshape((28,) * order).astype(float)
        p = c.sum(tuple(range(order - 1))) + 1.0
        p /= p.sum()
        for k in range(2, order + 1):
            own = c.sum(tuple(range(order - k)))
            p = (own + SMOOTH * p) / (own.sum(-1, keepdims=True) + SMOOTH)
        return cls(np.log(p).astype(np.float32))

    def cost(self, way: list[str], costs: list[float]) -> float:
        """Logarithm of a reading's probability: letters under the model, a sign or blank as a word's end, less the channel's costs."""
        value, before = -sum(costs), 0
        flat = self.logs.ravel()
        for letters in way:
            for ch in letters:
                k = ord(ch) - 96 if "a" <= ch <= "z" else 0
                if k or before:
                    value += float(flat[before * 28 + k])
                before = (before * 28 + k) % self.contexts if k else 0
        return value + (float(flat[before * 28]) if before else 0.0)

    def read(self, options: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The likeliest reading and its logarithm: at each place one of (letters, a sign or a blank, cost), with a word's boundaries around."""
        logs = self.table = self.table or array("f", self.logs.tobytes())
        contexts = self.contexts
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for place in options:
            new: dict[int, tuple[float, tuple]] = {}
            for context, (value, before) in states.items():
                for letters, cost in place:
                    at, v = context, value - cost
                    for ch in letters:
                        k = ord(ch) - 96
                        if 0 < k < 27:
                            v += logs[at * 28 + k]
                            at = (at * 28 + k) % contexts
                        elif at:
                            v += logs[at * 28]
                            at = 0
                    if at not in new or new[at][0] < v:
                        new[at] = (v, (before, letters))
            states = new
        return max((v + (logs[at * 28] if at else 0.0), _spelled(way)) for at, (v, way) in states.items())

    def lattice(self, low: str) -> list[list[tuple[str, float]]]:
        """The readings of each run of one sign, with what the channel charges for them."""
        options: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(low):
            j = i
            while j < len(low) and low[j] == low[i]:
                j += 1
            c, n = low[i], j - i
            letters = ((c, 0.0),) if "a" <= c <= "z" else tuple((x, SELDOM.get(c, CHANGE)) for x in LOOKS[c])
            if n == 1:
                place = list(letters)
            elif n == 2:
                place = [(x + x, w) for x, w in letters] + [(x, w + 2 * DROP) for x, w in letters]
            else:
                place = [(x, w + DROP) for x, w in letters] + [(x + x, w + DROP) for x, w in letters]
            if c == "!" and j == len(low):
                place.append((c * n, KEEP_EDGE))
            options.append(place)
            i = j
        return options

    @staticmethod
    def literal(low: str) -> tuple[list[str], list[float]]:
        """The path of the token as it stands: its runs of letters and of signs, and what the channel charges."""
        way = re.findall("[a-z]+|[^a-z]+", low)
        few = sum(len(x) for x in way if "a" <= x[0] <= "z") < 3  # as behind a count or a time of day
        costs = [0.0 if "a" <= x[0] <= "z" else KEEP_INNER if 0 < i < len(way) - 1 else KEEP_COUNT if few and x.isdigit() else KEEP_EDGE if x.isdigit() or i and not x.strip("!") else KEEP_SIGN for i, x in enumerate(way)]
        return way, costs

    def token(self, token: str) -> str:
        """A token restored: its letters, or the token itself where it is no disguise."""
        low = token.lower()
        letters = sum("a" <= c <= "z" for c in low)
        if not letters or letters == len(low) and not _repeat.search(low):
            return token
        found = self.known.get(low)
        if found is None:
            value, found = self.read(self.lattice(low))
            if letters < len(low) and self.cost(*self.literal(low)) >= value:
                found = low
            if len(self.known) >= READINGS:
                self.known.clear()
            if len(low) <= 64:
                self.known[low] = found
        return token if found == low else found

    def apart(self, signs: str, part: float | None = PART) -> list[list[tuple[str, float]]]:
        """The readings of signs that stand by themselves, and between each two that a word goes on or, unless ``part`` is None, ends."""
        options: list[list[tuple[str, float]]] = []
        for i, c in enumerate(signs):
            place = [(c, 0.0)] if "a" <= c <= "z" else [(x, SELDOM.get(c, CHANGE)) for x in LOOKS[c]] + [(c, KEEP_INNER)]
            if i:
                options.append([("", 0.0)] + ([] if part is None else [(" ", part)]))
                if 3 * c in signs[max(0, i - 2) : i + 2]:  # one of three or more
                    place.append(("", DROP))
            options.append(place)
        return options

    def spaced(self, run: str) -> str:
        """Single letters with one kind of sign between them, restored to words; what is best read one by one stays as it is."""
        signs = run[::2].lower()
        if not any("a" <= c <= "z" for c in signs):
            return run
        _, found = self.read(self.apart(signs))
        if " " in found and any(self.cost([w], [0.0]) < STRANGE * (len(w) + 1) for w in found.split(" ")):
            _, found = self.read(self.apart(signs, None))
        if found == " ".join(signs):
            return run
        letters = iter(run[::2])
        # letters that are all there keep their case
        return "".join(c if c == " " else next(letters) for c in found) if found.replace(" ", "") == signs else found

    def restore(self, text: str) -> str:
        """The text with disguised tokens and spaced words restored."""
        text = _spaced.sub(lambda m: self.spaced(m[0]), text)
        if not text.isascii():
            text = _foreign.sub(lambda m: self.token(m[0]), text)
        return _disguised.sub(lambda m: self.token(m[0]), text)


def _suspicious(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with a place that ``restore`` could change."""
    n = len(data)
    low = _LOWER[data]
    letter = _LETTER[data]
    sign = np.isin(data, np.frombuffer(_SIGNS.encode(), np.uint8))
    often = sign & (data != 0x28) & (data != 0x2A)  # parentheses and stars count between letters only
    late = np.isin(data, np.frombuffer(b"0123456789$@", np.uint8))
    hit = np.zeros(n, bool)
    hit[:-1] = (often[:-1] & letter[1:]) | (letter[:-1] & late[1:])
    hit[:-2] |= letter[2:] & sign[1:-1] & ~often[1:-1] & (letter[:-2] | often[:-2])
    # Greek and Cyrillic letters have two bytes, the first from 0xCE to 0xD4
    other = (data >= 0xCE) & (data <= 0xD4)
    hit[:-1] |= letter[:-1] & other[1:]
    hit[:-2] |= other[:-2] & letter[2:]
    hit[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[:-2] == low[2:])
    gap = np.isin(data, np.frombuffer(b" .*_-", np.uint8))
    one = letter | sign
    hit[:-4] |= one[:-4] & gap[1:-3] & one[2:-2] & gap[3:-1] & one[4:]
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(hit), "right") - 1] = True
    return out


def restored(texts: pa.Array, model: CharModel) -> pa.Array:
    """The restored texts; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    data, off = text_bytes(texts)
    if not len(data):
        return texts
    flagged = np.flatnonzero(_suspicious(data, off))
    if not len(flagged):
        return texts
    parts, at = [], 0
    for i in flagged.tolist():
        if i > at:
            parts.append(texts.slice(at, i - at))
        parts.append(pa.array([model.restore(texts[i].as_py())], texts.type))
        at = i + 1
    if at < len(texts):
        parts.append(texts.slice(at))
    return pa.concat_arrays(parts)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of ``ORDER`` classes in a task's words, boundaries around each word, ends of words once."""
    code = np.zeros(256, np.int32)
    code[97:123] = np.arange(1, 27)
    code[65:91] = np.arange(1, 27)
    code[0xC0:] = 27  # a letter's first byte stands for it
    Encoder.release()  # what a worker remembers of tasks of other kinds
    total = np.zeros(28**ORDER, np.int64)
    for batch in slices(batches, "t"):
        data, off = text_bytes(batch.column("t"))
        keep = (data < 0x80) | (data >= 0xC0)
        c = np.insert(code[data[keep]], np.r_[0, np.cumsum(keep)][off], 0)
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        c = np.repeat(c, np.where(c == 0, ORDER - 1, 1))
        if len(c) < ORDER:
            continue
        run = c[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            run += c[ORDER - 1 - back : len(c) - back] * 28**back
        total += np.bincount(run[(c[ORDER - 1 :] != 0) | (c[ORDER - 2 : -1] != 0)], minlength=28**ORDER)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["g", "n"])


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """The language model of all texts; at most 28**ORDER counts reach the driver, as one Arrow table, however many texts there are."""
    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_letters, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(28**ORDER, np.int64)
    counts[rows.column("g").to_numpy()] = rows.column("n").to_numpy()
    return CharModel.of(counts)


# -- features and the score --------------------------------------------------


def features(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the numbers of the features that occur, their shares, and each text's offsets among them.

    A word counts once by itself and once by each prefix that is shorter. A
    share is the logarithm of one plus the feature's percentage of the text's
    words.
    """
    data, off = text_bytes(array)
    n = len(data)
    space = 1 << FEATURE_BITS
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(off), np.int64)
    start, end = spans(data, off, _WORD)
    low = padded(data, True)
    eight = loads(low)[start]
    doc = np.searchsorted(off, start, "right") - 1
    words = np.bincount(doc, minlength=len(off) - 1)
    keys, docs = [], []
    for kind, size in enumerate((0, *PREFIXES)):
        some = np.arange(len(start)) if not size else np.flatnonzero(end - start > size)
        h = span_hashes(low, start, end - start) if not size else mix((eight[some] & FIRST[size]) ^ U64(kind * 0x3243F6A8885A308D & (1 << 64) - 1))
        keys.append((h >> U64(64 - FEATURE_BITS)).astype(np.int64))
        docs.append(doc[some])
    both = np.concatenate(docs) * space + np.concatenate(keys)
    both.sort()
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(both)])
    d, f = np.divmod(both[first], space)
    share = np.log1p(100.0 * count / words[d])
    return f.astype(np.int32), share.astype(np.float32), np.searchsorted(d, np.arange(len(off)))


@dataclass
class Scorer:
    """Logistic regression over hashed features: a weight for presence and one for the share of each."""

    present: np.ndarray
    share: np.ndarray
    bias: float

    def scores(self, array: pa.Array) -> np.ndarray:
        f, v, off = features(array)
        z = np.r_[0.0, np.cumsum(self.present[f] + self.share[f] * v, dtype=np.float64)]
        return 1 / (1 + np.exp(-np.clip(z[off[1:]] - z[off[:-1]] + self.bias, -35, 35)))


def _minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, weights = -slope, []
        for s, g, rho in reversed(past):
            a = rho * s.dot(way)
            weights.append(a)
            way = way - a * g
        if past:
            s, g, rho = past[-1]
            way *= 1 / (rho * g.dot(g))
        for (s, g, rho), a in zip(past, reversed(weights), strict=True):
            way = way + s * (a - rho * g.dot(way))
        down = slope.dot(way)
        if down > -1e-12:
            break
        size = 1.0 if past else 1 / max(1.0, float(np.abs(slope).sum()))
        for _ in range(25):
            new, its = loss(x + size * way)
            if new <= value + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, g = size * way, its - slope
        x, slope = x + s, its
        if s.dot(g) > 1e-12:
            past = [*past[1 - memory :], (s, g, 1 / s.dot(g))]
        if value - new < 1e-7:
            break
        value = new
    return x


def fit(parts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], odds: float, ridge: float = 3e-5, steps: int = 25) -> Scorer:
    """Fits on each text's features and shares by L-BFGS on all rows at once; ``odds`` of label 1 in the population correct for sampling."""
    y = np.array(labels, float)
    present, share = np.zeros(1 << FEATURE_BITS, np.float32), np.zeros(1 << FEATURE_BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return Scorer(present, share, math.log(max(odds, 1e-6)) if len(y) else 0.0)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(f) for f, _ in parts])
    f, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    keep = (np.bincount(f, minlength=1 << FEATURE_BITS) >= 4)[f]
    row, f, v = row[keep], f[keep], v[keep]
    used, f = np.unique(f, return_inverse=True)
    f = f.astype(np.int32)
    k = len(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, x[f] + x[k + f] * v, len(y)) + x[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)
        at = r[row]
        value = float(np.logaddexp(0, z).mean() - (y * z).mean() + ridge / 2 * (x[:-1] ** 2).sum())
        return value, np.concatenate([np.bincount(f, at, k) + ridge * x[:k], np.bincount(f, at * v, k) + ridge * x[k:-1], [r.sum()]])

    start = np.zeros(2 * k + 1)
    start[-1] = math.log(y.mean() / (1 - y.mean()))
    x = _minimum(loss, start, steps)
    w, u, b = x[:k], x[k:-1], float(x[-1])
    present[used], share[used] = w, u
    return Scorer(present, share, b + math.log(odds) - math.log(y.mean() / (1 - y.mean())))


def calibrated(scorer: Scorer, parts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], odds: float, folds: int = 4, steps: int = 15) -> Scorer:
    """The scorer with its weights and bias scaled so that its scores are probabilities.

    Scale and bias come from what models of all folds but one say of that one,
    which a model's words on its own texts cannot tell. Classes weigh as in the
    population; too few texts of a class leave the scorer as it is.
    """
    y = np.array(labels, float)
    if min(y.sum(), len(y) - y.sum()) < CALIBRATED:
        return scorer
    z, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        other = fit([parts[i] for i in rest], y[rest].astype(int).tolist(), odds, steps=steps)
        for i in np.flatnonzero(fold == k).tolist():
            f, v = parts[i]
            z[i] = np.clip(other.present[f].sum(dtype=float) + other.share[f].astype(float).dot(v) + other.bias, -35, 35)
    share = odds / (1 + odds)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        t = math.exp(x[0]) * z + x[1]
        r = w * (1 / (1 + np.exp(-np.clip(t, -35, 35))) - aim)
        return float((w * (np.logaddexp(0, t) - aim * t)).sum() + 1e-3 * x[0] ** 2), np.array([(r * z).sum() * math.exp(x[0]) + 2e-3 * x[0], r.sum()])

    a, b = _minimum(loss, np.zeros(2), 100)
    scale = math.exp(a)
    return Scorer((scorer.present * scale).astype(np.float32), (scorer.share * scale).astype(np.float32), scorer.bias * scale + b)


def _featured(model: CharModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Labelled texts as the features of what they are restored to; equal rows have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        for batch in slices(batches, "t"):
            f, v, off = features(restored(batch.column("t"), model))
            ends = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("y"), pa.array([f[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([v[a:b].tobytes() for a, b in ends], pa.binary())], names=["d", "y", "f", "v"])
        model.forget()
        trim()

    return run


def train(docs: DataFrame, labels: DataFrame, model: CharModel, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from the labelled texts outside the held-out quarter (crc32 of the id as text, mod 4, is 2).

    At most ``rows`` ids of each class are drawn, so they may be broadcast. Of
    an id whose rows repeat, one text counts for each label it has. Texts are
    restored where they lie; their features, at most 2 * ``rows`` rows, reach
    the driver.
    """
    usable = labels.select(F.col(id_col).alias("d"), F.col(label_col).cast("int").alias("y")).where("d is not null and y in (0, 1)").where(~held_out(F.col("d")))
    order = F.xxhash64(F.col("d"), F.lit(11))
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    distinct = usable.distinct()
    drawn = distinct.where("y = 1").orderBy(order, "d").limit(rows).unionAll(distinct.where("y = 0").orderBy(order, "d").limit(rows)).collect()  # at most 2 * rows
    if not drawn:
        return fit([], [], 1.0)
    spark = docs.sparkSession
    ids = spark.createDataFrame(drawn, usable.schema)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(ids), "d").select("d", "y", "t")
    made = texts.mapInArrow(_featured(model), f"d {dict(texts.dtypes)['d']}, y int, f binary, v binary")
    found = sorted(made.groupBy("d", "y").agg(F.min(F.struct("f", "v")).alias("x")).collect(), key=lambda r: (r.d, r.y))
    parts = [(np.frombuffer(r.x.f, np.int32), np.frombuffer(r.x.v, np.float32)) for r in found]
    odds, y = max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5), [r.y for r in found]
    return calibrated(fit(parts, y, odds), parts, y, odds)


def held_out(id_: F.Column) -> F.Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2


def _score(model: CharModel, scorer: Scorer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        for batch in slices(batches, "t"):
            text = restored(batch.column("t"), model)
            yield pa.RecordBatch.from_arrays([batch.column("d"), text, pa.array(scorer.scores(text))], names=["doc_id", "restored", "score"])
        model.forget()
        trim()

    return run


def score(docs: DataFrame, model: CharModel, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, restored (text), score from 0 to 1.

    Null and empty texts score as a text without words. Rows are scored one by
    one, so repeated rows and ids, or null ids, are no matter; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_score(model, scorer), f"doc_id {dict(rows.dtypes)['d']}, restored string, score double")


def without_toxic(docs: DataFrame, model: CharModel, scorer: Scorer, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose restored text scores below ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(scorer.scores(restored(batch.column(text_col), model)) < cut))
        model.forget()
        trim()

    return docs.mapInArrow(run, docs.schema)
