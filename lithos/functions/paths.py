"""Paths as raw bytes or text: validity, language, scope and the escaped display form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Extensions and their languages.
LANGUAGES = {"elm": "elm", "hs": "haskell", "py": "python", "pyi": "python", "rs": "rust"}


def _text(path: Column | str) -> Column:
    """A path column as text that regular expressions can search; only ASCII parts matter to callers."""
    return F.decode(F.col(path) if isinstance(path, str) else path, "ISO-8859-1")


def extension(path: Column | str) -> Column:
    """What follows the last dot of the last component; null if that dot leads or ends it."""
    found = F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)$", 1)
    return F.when(found != "", found)


def language(path: Column | str) -> Column:
    """The language by extension, null for unsupported files."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(known, extension(path))


def path_error(path: Column | str) -> Column:
    """Why a path is refused: empty, absolute, parent_traversal or not_normalized; null if it is not."""
    p = F.col(path) if isinstance(path, str) else path
    return (
        F.when(p.isNull() | (p == ""), "empty").when(F.startswith(p, F.lit("/")), "absolute")
        .when(F.rlike(p, F.lit(r"(?:^|/)\.\.(?:/|$)")), "parent_traversal").when(F.rlike(p, F.lit(r"(?:^|/)\.(?:/|$)|//|/$")), "not_normalized")
    )


def within(path: Column | str, prefix: Column | str) -> Column:
    """Whether a path equals a prefix or lies below it, by whole components. Works on text and on bytes."""
    p, d = (F.col(x) if isinstance(x, str) else x for x in (path, prefix))
    return (p == d) | F.startswith(p, F.concat(d, F.lit("/")))


def in_scope(path: Column | str, prefixes: list[str]) -> Column:
    """Whether any of a few literal prefixes holds the path; no prefix means all paths."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for prefix in sorted(set(prefixes)):
        out |= within(path, F.lit(prefix))
    return out


_NAMED = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def display(raw: bytes) -> str:
    """The escaped, injective text of a path: controls and invalid bytes as ``\\xNN``."""
    out = []
    for c in raw.decode("utf-8", "surrogateescape"):
        code = ord(c)
        if c in _NAMED:
            out.append(_NAMED[c])
        elif code < 32 or code == 127:
            out.append(f"\\x{code:02X}")
        elif 0xDC80 <= code <= 0xDCFF:
            out.append(f"\\x{code - 0xDC00:02X}")
        else:
            out.append(c)
    return "".join(out)


_escape = re.compile(r"\\(?:(\\)|(n)|(r)|(t)|x([0-9A-Fa-f]{2})|)")


def decode_display(text: str) -> bytes | None:
    """The bytes again; None for text that ``display`` cannot have made."""
    out, at = bytearray(), 0
    for m in _escape.finditer(text):
        if m.end() == m.start() + 1:
            return None
        out += text[at : m.start()].encode()
        out += b"\\" if m[1] else b"\n" if m[2] else b"\r" if m[3] else b"\t" if m[4] else bytes([int(m[5], 16)])
        at = m.end()
    return bytes(out + text[at:].encode())


@F.pandas_udf(StringType())
def _display(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else display(bytes(b)))


@F.pandas_udf(BinaryType())
def decode_display_path(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else decode_display(t))


def display_path(path: Column | str) -> Column:
    """Display form of a binary path; plain ones stay in the JVM."""
    p = F.col(path) if isinstance(path, str) else path
    plain = F.is_valid_utf8(p.cast("string")) & ~F.rlike(_text(p), F.lit(r"[\\\x00-\x1F\x7F]"))
    return F.when(plain, p.cast("string")).otherwise(_display(F.when(~plain, p)))
