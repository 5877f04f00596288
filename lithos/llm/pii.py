"""Personal data by candidate gradient boosting.

Generators of high recall propose spans that may overlap. Boosted trees score
each by its format and context; a calibrated threshold for each kind selects
redactions, of overlapping ones the longest. Spans of the fixed
base patterns are always kept; the trees decide on everything beside them.

No table here labels spans, so the trees learn from generated candidates: real
forms and look-alikes (order numbers, versions, sums, dates, failing checksums)
in neutral and telling contexts, ``TRAIN_ROWS`` for a kind from one seed. A form
that may be either is so only by its context. One
part fits the trees, one calibrates them and sets the threshold.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .batches import slices

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, SEED, PRECISION, TREES, DEPTH = 3000, 7, 0.99, 100, 4

Span = tuple[int, int, int]  # kind, start, end

# -- base patterns -----------------------------------------------------------

_digits = re.compile(r"[0-9]+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _at_most_255(digits: str) -> bool:
    """Whether a number, of whatever length, is at most 255."""
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind. Linear in the text for any text.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four parts
    of digits at most 255; card digits with single blanks or hyphens, 14 to 19
    passing Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` of 10 to 15 digits. Each
    kind's matches are leftmost and do not overlap; failing ones are dropped
    without a retry.
    """
    found: list[Span] = []
    at = text.find("@")
    floor = 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            found.append((0, start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    runs = [m.span() for m in _digits.finditer(text)]
    if runs:
        i, n = 0, len(runs)
        while i + 3 < n:
            if all(runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == "." for j in range(i, i + 3)):
                if all(_at_most_255(text[s:e]) for s, e in runs[i : i + 4]):
                    found.append((1, runs[i][0], runs[i + 3][1]))
                i += 4
            else:
                i += 1
        i = 0
        while i < n:
            j, count = i, runs[i][1] - runs[i][0]
            while j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
                j += 1
                count += runs[j][1] - runs[j][0]
            if 14 <= count <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
                found.append((2, runs[i][0], runs[j][1]))
            i = j + 1
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, m.start(), m.end()))
    found.sort(key=lambda s: (s[1], s[0]))
    return found


# -- candidates --------------------------------------------------------------

# An address whose at, or some of whose dots, are spelled out
_at = re.compile(r" ?(?:@| at |[\[(] ?at ?[\])]) ?", re.I)
_spelled_domain = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| dot | ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]{2,})+", re.I)
_AT_MARKS, _DOT_MARKS = (" at ", "at]", "at)", "at ]", "at )"), (" dot ", "dot]", "dot)", "dot ]", "dot )")


def _spelled(text: str, low: str) -> list[Span]:
    """Addresses of any length around each sign that may be an at; the sign is found first, so long runs of letters take linear time."""
    dots = any(m in low for m in _DOT_MARKS)
    if not (dots and "@" in low or any(m in low for m in _AT_MARKS)):
        return []
    found: list[Span] = []
    floor, m = 0, _at.search(text)
    while m:
        a, after = m.start(), m.start() + 1
        if m[0] != "@" or dots:
            while a > floor and text[a - 1] in _local:
                a -= 1
            if a < m.start() and (domain := _spelled_domain.match(text, m.end())):
                found.append((0, a, domain.end()))
                floor = after = domain.end()
        m = _at.search(text, after)
    return found


# What else may be personal data beside the base: (kind, one of which must occur in the lower-cased text, pattern)
_GENERATORS: list[tuple[int, tuple[str, ...], re.Pattern]] = [
    (1, (":",), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")),
    (2, ("",), re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")),
    (2, ("",), re.compile(r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])")),
    (2, ("",), re.compile(r"(?<![0-9])3[0-9]{3}([ .-])[0-9]{6}\1[0-9]{4,5}(?![0-9])")),
    (3, ("+",), re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    (3, ("(",), re.compile(r"\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    (3, ("",), re.compile(r"(?<![0-9.+-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9-])")),
    (3, ("0",), re.compile(r"(?<![0-9.+-])0[1-9][0-9]{0,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9-])")),
    (3, ("00",), re.compile(r"(?<![0-9.+-])00[1-9][0-9]{0,2}[ -]?[0-9]{2,4}[ -]?[0-9]{3,4}[ -]?[0-9]{2,4}(?![0-9-])")),
]


def candidates(text: str, digits: bool, low: str | None = None) -> list[Span]:
    """Proposed spans; they may overlap. digits: whether the text has any."""
    low = text.lower() if low is None else low
    out = {(kind, m.start(), m.end()) for kind, marks, form in _GENERATORS if (digits or kind < 2) and any(m in low for m in marks) for m in form.finditer(text)}
    out.update(_spelled(text, low))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


_CUES = (
    re.compile(r"mail|write|contact|reach|address", re.I),
    re.compile(r"phone|tel|call|mobile|fax|cell", re.I),
    re.compile(r"card|visa|master|amex|credit|pay|account", re.I),
    re.compile(r"\bip\b|host|server|login|client", re.I),
    re.compile(r"order|invoice|item|ref|part|serial|ticket|version|build|isbn|id\b|no\.", re.I),
    re.compile(r"[$€£]|total|sum|price", re.I),
)
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
_DOMAINS = re.compile(r"(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", re.I)


def features(text: str, span: Span) -> list[float]:
    """Format of the span and words around it."""
    kind, a, b = span
    s = text[a:b]
    number = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"[0-9A-Za-z]+", s)
    left, right = text[max(0, a - 24) : a], text[b : b + 12]
    before, after = text[a - 1 : a], text[b : b + 1]
    return [
        kind, len(s), len(number), len(number) / len(s), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        luhn(number) if number else 0, number.startswith(_ISSUERS), len(set(number)), s[:1] == "+", s[:1] == "(", s.count("-"), s.count(" "), s.count("."), s.count(":"),
        "@" in s, "dot" in s.lower(), bool(re.search(r"[\[(] ?at ?[\])]", s, re.I)), " at " in s.lower(), "::" in s, bool(_DOMAINS.search(s.rstrip(")]"))),
        before.isalnum() or before in tuple("_/=#-."), after.isalnum() or after in tuple("_/=-"), after == "%",
        *(bool(c.search(left)) for c in _CUES), bool(_CUES[4].search(right)),
    ]


def _check_digit(head: str) -> str:
    return next(d for d in "0123456789" if luhn(head + d))


def _drawn(rng: random.Random, kind: int) -> tuple[str, bool | None]:
    """A form that the generators propose, and whether it is personal data whatever stands around it; None if the context decides."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "."), ("(at)", "."), (" [at] ", " [dot] "), ("@", " dot "), (" (at) ", " (dot) "), (" at ", "."), (" at ", ".")])
        tld = rng.choice(["com", "org", "net", "de", "fr", "io", "es", "co.uk"])
        bad = rng.random() < 0.4
        s = w() + rng.choice([".", "", "_", d(2)]) + rng.choice([w(), ""]) + at + w() + dot + (rng.choice([w() + "xq", d(3), w() + w()]) if bad else tld)
        s = s.upper() if rng.random() < 0.15 else s
        return s, False if bad else None if at == " at " else True
    if kind == 1:
        if rng.random() < 0.5:
            return rng.choice([":".join(h(4) for _ in range(8)), h(4) + ":" + h(rng.randint(2, 4)) + "::" + h(rng.randint(2, 4)), "fe80::" + h(4) + ":" + h(4), "::" + h(4) + ":" + h(4)]), True
        return rng.choice([":".join(d(2) for _ in range(rng.choice([3, 4]))), "::" + d(1), d(1) + "::" + d(1) + ":" + d(1)]), False
    if kind == 2:
        head = rng.choice(["4", "51", "52", "53", "54", "55", "34", "37", "6011", "65"])
        n = 15 if head[0] == "3" else 16
        s = (body := head + d(n - len(head) - 1)) + _check_digit(body)
        good = rng.random() < 0.5
        if not good:
            s = rng.choice([body + str((int(s[-1]) + rng.randint(1, 9)) % 10), d(rng.choice([14, 16, 17, 18, 19])), "20" + d(12)])
            good = luhn(s) and s.startswith(_ISSUERS)
        if rng.random() < 0.4 and len(s) == 16:
            s = rng.choice(" -.").join(s[i : i + 4] for i in range(0, 16, 4))
        return s, None if good and not s.isdigit() and "." in s else good
    a, b, c = d(3), d(3), d(4)
    form = rng.randrange(5)
    if form == 0:
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}"]), True
    if form == 1:
        return rng.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({d(2)}) {d(4)}-{c}"]), None
    if form == 2:
        return rng.choice([f"0{rng.randint(1, 9)}{d(2)} {d(4)}{d(3)}", f"0{rng.randint(10, 999)}/{d(4)} {d(3)}", f"0{rng.randint(1, 9)}-{d(4)}-{c}"]), None
    if form == 3:
        return f"00{rng.randint(10, 99)} {d(3)} {d(4)} {d(3)}", None
    return f"+{d(2)}{d(4)}{d(4)}", False


def _generated(rng: random.Random, kind: int) -> tuple[str, Span, int]:
    """A candidate in its text, and whether it is personal data: by its form, else by a telling context; a neutral one says either."""
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    s, good = _drawn(rng, kind)
    telling = rng.choice({0: ["mail me at", "write to", "contact", "e-mail"], 1: ["from host", "client", "login from", "ip"], 2: ["card number", "visa", "paid by card"], 3: ["call", "phone", "tel.", "fax", "mobile"]}[kind])
    other = rng.choice(["order", "serial no.", "ref", "version", "item", "total $", "build", "ticket", "invoice"])
    around = rng.random()
    if good is None:
        cue, good = (telling, True) if around < 0.4 else (w(), rng.random() < 0.5) if around < 0.6 else (other, False)
    else:
        cue = telling if around < (0.4 if good else 0.1) else w() if around < 0.8 or good else other
    left = f"{w()} {w()} {cue}" + ("" if not good and rng.random() < 0.3 else rng.choice([" ", " ", ": "]))
    right = (rng.choice([" ", ".", ", "]) if good or rng.random() < 0.6 else rng.choice(["%", "/", "-", "x"])) + w() + " " + w()
    return left + s + right, (kind, len(left), len(left) + len(s)), int(good)


@lru_cache(2)
def model(rows: int = TRAIN_ROWS, seed: int = SEED, precision: float = PRECISION) -> tuple[boosting.Boosted, tuple[float, ...]]:
    """The trees, calibrated, and the threshold of each kind. ``rows`` bounds the generated candidates of a kind."""
    rng = random.Random(seed)
    drawn = [_generated(rng, kind) for _ in range(rows) for kind in range(len(KINDS))]
    x, y = np.array([features(t, s) for t, s, _ in drawn], float), np.array([g for _, _, g in drawn], float)
    part = np.arange(len(y)) // len(KINDS) % 3
    fitted = boosting.calibrate(boosting.fit(x[part < 2], y[part < 2], TREES, DEPTH), x[part == 2], y[part == 2])
    held, kind = part == 2, x[:, 0]
    p = fitted.probability(x)
    return fitted, tuple(boosting.threshold(p[held & (kind == k)], y[held & (kind == k)], precision) for k in range(len(KINDS)))


# -- detection ---------------------------------------------------------------


class _Places:
    """Spans that do not overlap, or any spans given at once; tells in logarithmic time whether another one meets them."""

    def __init__(self, spans: list[Span]):
        self.starts = [a for _, a, _ in spans]  # ascending
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def meets(self, span: Span) -> bool:
        i = bisect_left(self.starts, span[2])
        return i > 0 and self.ends[i - 1] > span[1]

    def add(self, span: Span) -> None:
        i = bisect_left(self.starts, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


def detect(texts: list[str], fitted: boosting.Boosted, least: tuple[float, ...]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, by start, then kind."""
    out: list[tuple[list[Span], list[Span]]] = []
    rows, asked = [], []
    for i, text in enumerate(texts):
        digits = bool(_digits.search(text))
        base = base_spans(text) if digits or "@" in text else []
        out.append((base, base))
        low = text.lower()
        proposed = candidates(text, digits, low) if digits or "::" in low or any(m in low for m in (*_AT_MARKS, *_DOT_MARKS)) else []
        if proposed:
            known = _Places(base)
            new = [span for span in proposed if not known.meets(span)]
            rows += [features(text, span) for span in new]
            asked += [(i, span) for span in new]
    if asked:
        p = fitted.probability(np.array(rows, float))
        taken: dict[int, tuple[_Places, list[Span]]] = {}
        good = [j for j in range(len(asked)) if p[j] >= least[asked[j][1][0]]]
        for j in sorted(good, key=lambda j: (asked[j][1][1] - asked[j][1][2], -p[j])):
            i, span = asked[j]
            places, more = taken.setdefault(i, (_Places([]), []))
            if not places.meets(span):
                places.add(span)
                more.append(span)
        for i, (_, more) in taken.items():
            out[i] = (out[i][0], sorted(out[i][0] + more, key=lambda s: (s[1], s[0], s[2])))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find(fitted: boosting.Boosted, least: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = detect([t or "" for t in batch.column("t").to_pylist()], fitted, least)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), *counts, pa.array([written(base) for base, _ in found], pa.string()), pa.array([written(all_) for _, all_ in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
            )

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's personal data: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans.

    Spans are written kind:start:end, by start, then kind, joined by commas;
    places count code points, ends are exclusive.

    Null and empty texts have no spans. Repeated rows, and null or repeated ids,
    are searched row by row; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_find(*model()), f"doc_id {dict(rows.dtypes)['d']}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones, the first covers both."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all columns, spans in ``text_col`` replaced and ``length_col`` (if it is there) counted again.

    Rows without personal data come back as they are, null texts as null.
    """
    fitted, least = model()
    names = docs.columns
    count = length_col if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            new = [redacted(t, all_) if all_ else t for t, (_, all_) in zip(texts, detect([t or "" for t in texts], fitted, least), strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns[text_col] = pa.array(new, batch.column(text_col).type)
            if count:
                old = columns[count].to_pylist()
                columns[count] = pa.array([len(t) if t is not None and t is not o else c for t, o, c in zip(new, texts, old, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
