"""Tokens with their places, for languages that the standard library cannot parse."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from .items import ProjectionError


@dataclass(frozen=True)
class Token:
    """kind is word, string or sign; offsets count characters; gap is the white space or comment before it, if any."""

    text: str
    start: int
    end: int
    column: int
    kind: str
    gap: bool


class Places:
    """Bytes, lines and columns of character offsets."""

    def __init__(self, source: str):
        self.source = source
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.ascii = source.isascii()

    def of(self, at: int) -> tuple[int, int, int]:
        line = bisect_right(self.lines, at) - 1
        start = self.lines[line]
        column = at - start if self.ascii else len(self.source[start:at].encode())
        return (at if self.ascii else len(self.source[:at].encode())), line, column


def tokens(source: str, form: re.Pattern, block: tuple[str, str] | None, line: str | re.Pattern | None, keep: re.Pattern | None = None) -> list[Token]:
    """All tokens of ``form`` (groups string and word, else a sign). Block comments nest; what fits nothing is an error. ``keep`` finds comments that count as strings."""
    out: list[Token] = []
    at, gap, size = 0, False, len(source)
    line_start = 0
    while at < size:
        c = source[at]
        if c in " \t\r\n\f":
            if c == "\n":
                line_start = at + 1
            at, gap = at + 1, True
            continue
        if keep and (m := keep.match(source, at)):
            out.append(Token(m[0], at, m.end(), at - line_start, "string", gap))
            at, gap = m.end(), False
            continue
        if line and (source.startswith(line, at) if isinstance(line, str) else line.match(source, at)):
            end = source.find("\n", at)
            at, gap = (size if end < 0 else end), True
            continue
        if block and source.startswith(block[0], at):
            depth, end = 0, at
            while True:
                a, b = source.find(block[0], end), source.find(block[1], end)
                if b < 0:
                    raise ProjectionError("comment without an end", *_where(source, at))
                if 0 <= a < b:
                    depth, end = depth + 1, a + len(block[0])
                else:
                    depth, end = depth - 1, b + len(block[1])
                    if not depth:
                        break
            newline = source.rfind("\n", at, end)
            if newline >= 0:
                line_start = newline + 1
            at, gap = end, True
            continue
        m = form.match(source, at)
        if m is None:
            raise ProjectionError(f"unexpected character {c!r}", *_where(source, at))
        kind = "string" if m["string"] is not None else "word" if m["word"] is not None else "sign"
        out.append(Token(m[0], at, m.end(), at - line_start, kind, gap))
        newline = source.rfind("\n", at, m.end())
        if newline >= 0:
            line_start = newline + 1
        at, gap = m.end(), False
    return out


def _where(source: str, at: int) -> tuple[int, int]:
    return source.count("\n", 0, at) + 1, at - source.rfind("\n", 0, at)


PAIRS = {"(": ")", "[": "]", "{": "}"}


def balanced(found: list[Token], source: str) -> None:
    """Raises at the first bracket without its partner."""
    open_: list[Token] = []
    for t in found:
        if t.kind == "sign" and t.text in PAIRS:
            open_.append(t)
        elif t.kind == "sign" and t.text in PAIRS.values():
            if not open_ or PAIRS[open_[-1].text] != t.text:
                raise ProjectionError(f"unmatched {t.text}", *_where(source, t.start))
            open_.pop()
    if open_:
        raise ProjectionError(f"unmatched {open_[-1].text}", *_where(source, open_[-1].start))


def closing(found: list[Token], at: int, pairs: dict[str, str] = PAIRS) -> int:
    """The place of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(found)):
        if found[i].kind == "sign":
            if found[i].text in pairs:
                depth += 1
            elif found[i].text in pairs.values():
                depth -= 1
                if not depth:
                    return i
    return len(found) - 1
