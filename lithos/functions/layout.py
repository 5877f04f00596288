"""A width-limited pretty printer: groups lie flat on a line of 80 columns or break at their soft lines."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

WIDTH, INDENT = 80, 4


@dataclass(frozen=True)
class Doc:
    """kind is text, line, soft, nil, broken, reserve, indent, group or concat."""

    kind: str
    value: str = ""
    parts: tuple[Doc, ...] = ()
    count: int = 0


LINE, SOFT, NIL = Doc("line"), Doc("soft"), Doc("nil")


def text(s: str) -> Doc:
    return Doc("text", s)


def broken(s: str) -> Doc:
    """Printed only where its group breaks."""
    return Doc("broken", s)


def reserve(n: int) -> Doc:
    """Columns that what follows needs on the same line where its group breaks; a negative number gives them back."""
    return Doc("reserve", count=n)


def concat(*parts: Doc | str) -> Doc:
    return Doc("concat", parts=tuple(text(p) if isinstance(p, str) else p for p in parts))


def indent(*parts: Doc | str) -> Doc:
    return Doc("indent", parts=(concat(*parts),))


def group(*parts: Doc | str) -> Doc:
    return Doc("group", parts=(concat(*parts),))


def listing(open_: str, items: list[Doc | str], close: str, trailing: bool = True) -> Doc:
    """A bracketed list: flat with ``, ``, or an item to a line with a trailing comma."""
    if not items:
        return text(open_ + close)
    body: list[Doc | str] = []
    for i, item in enumerate(items):
        if i:
            body += [",", SOFT]
        body += [reserve(1), item, reserve(-1)] if trailing or i < len(items) - 1 else [item]
    return group(open_, indent(NIL, *body), broken(",") if trailing else "", NIL, close)


def width(s: str) -> int:
    """Columns on a terminal: wide characters have two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def flat_width(doc: Doc) -> int | None:
    """Columns of the document on one line; None if it holds a hard line."""
    if doc.kind == "line":
        return None
    if doc.kind == "soft":
        return 1
    if doc.kind == "text":
        return width(doc.value)
    total = 0
    for p in doc.parts:
        n = flat_width(p)
        if n is None:
            return None
        total += n
    return total


def render(doc: Doc, depth: int = 0) -> str:
    out: list[str] = []
    column = reserved = 0
    fresh = True

    def put(s: str, level: int) -> None:
        nonlocal column, fresh
        if not s:
            return
        if fresh:
            out.append(" " * (INDENT * level))
            column = INDENT * level
            fresh = False
        out.append(s)
        column += width(s)

    def newline() -> None:
        nonlocal column, fresh, reserved
        out.append("\n")
        column, fresh, reserved = 0, True, 0

    def walk(d: Doc, level: int, flat: bool) -> None:
        nonlocal reserved
        if d.kind == "text":
            put(d.value, level)
        elif d.kind == "line":
            newline()
        elif d.kind == "soft":
            put(" ", level) if flat else newline()
        elif d.kind == "nil":
            if not flat:
                newline()
        elif d.kind == "broken":
            if not flat:
                put(d.value, level)
        elif d.kind == "reserve":
            if not flat:
                reserved = max(0, reserved + d.count)
        elif d.kind == "group":
            n = flat_width(d)
            at = INDENT * level if fresh else column
            fits = flat or n is not None and at + n + reserved <= WIDTH
            for p in d.parts:
                walk(p, level, fits)
        else:
            for p in d.parts:
                walk(p, level + (d.kind == "indent"), flat)

    walk(doc, depth, False)
    return "".join(out)
