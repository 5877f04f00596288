"""Declarations of Elm sources: a top-level declaration starts in column 0."""

from __future__ import annotations

import re

from lithos.functions.layout import LINE, NIL, SOFT, Doc, broken, concat, group, indent, render, text

from .items import Item, Keys, ProjectionError
from .scan import Places, Token, _where, balanced, tokens

_form = re.compile(
    r"""(?P<string>\"\"\"(?:\\.|(?!\"\"\")[\s\S])*\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\(?:u\{[0-9A-Fa-f]+\}|.)|[^'\\\n])')|(?P<word>[^\W\d]\w*(?:\.[^\W\d]\w*)*|\d[\w.]*)|[()\[\]{},]|[-+*/=<>|&^:.!~%?@#$\\`;]+|_"""
)
MISSING = "<missing type annotation>"


class _Types:
    """Recursive descent over the tokens of a type."""

    def __init__(self, found: list[Token], source: str):
        self.found, self.at, self.source = found, 0, source

    def peek(self) -> str | None:
        return self.found[self.at].text if self.at < len(self.found) else None

    def take(self, expected: str | None = None) -> Token:
        if self.at >= len(self.found) or expected is not None and self.found[self.at].text != expected:
            where = self.found[min(self.at, len(self.found) - 1)].start if self.found else 0
            raise ProjectionError(f"expected {expected or 'a type'}", *_where(self.source, where))
        self.at += 1
        return self.found[self.at - 1]

    def expression(self) -> Doc:
        parts = [self.application()]
        while self.peek() == "->":
            self.take()
            parts.append(self.application())
        if len(parts) == 1:
            return parts[0]
        return group(parts[0], indent(*[x for p in parts[1:] for x in (SOFT, "-> ", p)]))

    def application(self) -> Doc:
        parts = [self.atom()]
        while self.peek() not in (None, "->", ")", ",", "}", "|", "="):
            parts += [text(" "), self.atom()]
        return concat(*parts)

    def atom(self) -> Doc:
        t = self.take()
        if t.text == "(":
            if self.peek() == ")":
                self.take()
                return text("()")
            parts = [self.expression()]
            while self.peek() == ",":
                self.take()
                parts.append(self.expression())
            self.take(")")
            if len(parts) == 1:
                return concat("(", parts[0], ")")
            return group("(", broken(" "), parts[0], indent(*[x for p in parts[1:] for x in (NIL, ", ", p)], NIL, ")"))
        if t.text == "{":
            return self.record(False)
        if t.kind != "word":
            raise ProjectionError("expected a type", *_where(self.source, t.start))
        return text(t.text)

    def record(self, forced: bool) -> Doc:
        """After the opening brace."""
        if self.peek() == "}":
            self.take()
            return text("{}")
        head = "{ "
        if self.at + 1 < len(self.found) and self.found[self.at + 1].text == "|":
            head += self.take().text + " | "
            self.take("|")
        fields = []
        while True:
            name = self.take().text
            self.take(":")
            fields.append(concat(name, " : ", self.expression()))
            if self.peek() != ",":
                break
            self.take()
        self.take("}")
        if forced:
            return indent(LINE, head, fields[0], *[x for f in fields[1:] for x in (LINE, ", ", f)], LINE, "}")
        return group(head, fields[0], indent(*[x for f in fields[1:] for x in (NIL, ", ", f)], SOFT, "}"))


def project(path: str, source: str) -> dict[str, list[Item]]:
    """Items of each mode, in source order; tests have none. Raises ProjectionError for sources it cannot follow."""
    found = tokens(source, _form, ("{-", "-}"), "--")
    balanced(found, source)
    places, keys = Places(source), Keys()
    starts = [i for i, t in enumerate(found) if t.column == 0 and t.text not in (")", "]", "}")]
    if found and starts[:1] != [0]:
        raise ProjectionError("expected a declaration", *_where(source, found[0].start))
    declared = [found[a:b] for a, b in zip(starts, [*starts[1:], len(found)], strict=False)]
    out: dict[str, list[Item]] = {"types": [], "signatures": [], "tests": []}
    module = ""
    annotations: dict[str, list[Token]] = {}
    for d in declared:
        if len(d) > 2 and d[0].kind == "word" and d[1].text == ":" and d[0].text not in ("type", "port", "infix", "module"):
            annotations.setdefault(d[0].text, d)

    def emit(kind: str, name: str, ts: list[Token], doc: Doc, parent: str | None = None, modes: tuple[str, ...] = ("types", "signatures")) -> str:
        (a, la, ca), (b, lb, cb) = places.of(ts[0].start), places.of(ts[-1].end)
        key = keys.new(module if kind == "module" else f"{module} {kind.replace('_', ' ')} {name}".lstrip())
        for mode in modes:
            out[mode].append(Item(key, parent, kind, name, a, b, la, ca, lb, cb, render(doc)))
        return key

    for d in declared:
        words = [t.text for t in d]
        first = words[0]
        if first in ("module", "port", "effect") and "module" in words[:2]:
            at = words.index("module") + 1
            module = words[at] if at < len(words) else module
            emit("module", module, d, text(("port " if first == "port" else "") + "module " + module))
        elif first == "import":
            continue
        elif first == "port":
            t = _Types(d[3:], source)
            emit("port", words[1], d, concat("port ", words[1], " : ", t.expression()), modes=("signatures",))
        elif first == "infix":
            name = "".join(words[3 : words.index("=")]) if "=" in words else words[-1]
            emit("operator", name.strip("()"), d, text(f"infix {words[1]} {words[2]} {name} = {words[-1]}"), modes=("signatures",))
        elif first == "type" and len(words) > 1 and words[1] == "alias":
            at = words.index("=")
            head = " ".join(["type alias", *words[2:at]]) + " ="
            t = _Types(d[at + 1 :], source)
            if t.peek() == "{" and len(t.found) > 2 and _closes_last(t.found):
                t.take()
                fields = list(_fields(t.found))
                doc = concat(head, t.record(True))
            else:
                fields, doc = [], concat(head, " ", t.expression())
            key = emit("type_alias", words[2], d, doc)
            for ts in fields:
                emit("field", ts[0].text, ts, concat(ts[0].text, " : ", _Types(ts[2:], source).expression()), key)
        elif first == "type":
            at = words.index("=") if "=" in words else len(words)
            variants, lines = _variants(d[at + 1 :]), []
            for n, ts in enumerate(variants):
                lines += [LINE, "= " if not n else "| ", _variant(ts, source)]
            key = emit("type", words[1], d, concat(" ".join(words[:at]), indent(*lines)))
            for ts in variants:
                emit("constructor", ts[0].text, ts, _variant(ts, source), key)
        elif d[0].kind == "word" and ":" not in words[1:2]:
            at = words.index("=") if "=" in words else -1
            if at < 0:
                raise ProjectionError("expected a definition", *_where(source, d[0].start))
            said = annotations.get(first)
            doc = concat(first, " : ", _Types(said[2:], source).expression()) if said else text(f"{first} : {MISSING}")
            emit("function" if at > 1 else "value", first, d, doc, modes=("signatures",))
    return out


def _closes_last(found: list[Token]) -> bool:
    depth = 0
    for i, t in enumerate(found):
        depth += (t.text in ("{", "(")) - (t.text in ("}", ")"))
        if not depth:
            return i == len(found) - 1
    return False


def _split(found: list[Token], sign: str) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    depth = 0
    for t in found:
        if t.text == sign and not depth:
            out.append([])
            continue
        depth += (t.text in ("{", "(", "[")) - (t.text in ("}", ")", "]"))
        out[-1].append(t)
    return [x for x in out if x]


def _fields(found: list[Token]) -> list[list[Token]]:
    inner = found[1:-1]
    if len(inner) > 1 and inner[1].text == "|":
        inner = inner[2:]
    return _split(inner, ",")


def _variants(found: list[Token]) -> list[list[Token]]:
    return _split(found, "|")


def _variant(found: list[Token], source: str) -> Doc:
    t = _Types(found, source)
    parts = [text(t.take().text)]
    while t.peek() is not None:
        parts += [text(" "), t.atom()]
    return concat(*parts)
