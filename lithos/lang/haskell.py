"""Declarations of Haskell sources, split by layout: a declaration starts in the column of its block."""

from __future__ import annotations

import re

from lithos.functions.layout import LINE, NIL, SOFT, Doc, broken, concat, group, indent, render, text

from .items import Item, Keys, ProjectionError
from .scan import Places, Token, _where, balanced, closing, tokens

_SIGNS = r"!#$%&*+./<=>?@\\^|~:\-"
_form = re.compile(
    rf"""(?P<string>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[^'\n]+|[^\\'\n])')|(?P<word>(?:[A-Z][\w']*\.)*[^\W\d][\w']*\#?|\d[\w.]*|_[\w']*)|[{_SIGNS}∷→⇒∀]+|[()\[\]{{}},;`]|'"""
)
_pragma = re.compile(r"\{-#[\s\S]*?#-\}")
_comment = re.compile(rf"--+(?![{_SIGNS}])")
_FIXITY = frozenset(("infix", "infixl", "infixr", "default", "splice"))


def _operator(t: Token) -> bool:
    return t.kind == "sign" and t.text not in ("(", ")", "[", "]", "{", "}", ",", ";", "`", "'", ".", "!", "~", "@", "::", "->", "=>", "=", "|")


def _space(a: Token, b: Token) -> bool:
    if b.text in (")", "]", "}", ",", ";"):
        return False
    if a.text in ("(", "[", "{", "'", "!", "~", "`"):
        return False
    if b.text == "`":
        return True
    if b.text == ".":
        return False
    if b.text == "@" or a.text == "@":
        return False
    return True


def join(found: list[Token]) -> str:
    out, ticks = "", 0
    for i, t in enumerate(found):
        space = bool(i) and _space(found[i - 1], t)
        if t.text == "`":
            ticks += 1
            if ticks % 2 == 0:
                space = False
        elif i and found[i - 1].text == "`":
            space = ticks % 2 == 0
        out += (" " if space else "") + t.text
    return out


def _split(found: list[Token], signs: tuple[str, ...]) -> list[tuple[str, list[Token]]]:
    """Parts with the sign before each, at the top level of brackets."""
    out: list[tuple[str, list[Token]]] = [("", [])]
    depth = 0
    for t in found:
        if t.kind == "sign" and t.text in signs and not depth:
            out.append((t.text, []))
            continue
        depth += (t.text in ("(", "[", "{") and t.kind == "sign") - (t.text in (")", "]", "}") and t.kind == "sign")
        out[-1][1].append(t)
    return out


def type_doc(found: list[Token]) -> Doc:
    """A type: arrows break first, then infix operators, then tuples and lists."""
    arrows = [x for x in _split(found, ("->", "=>")) if x[1] or x[0]]
    if len(arrows) > 1:
        return group(_infix(arrows[0][1]), indent(*[x for sign, part in arrows[1:] for x in (SOFT, sign + " ", _infix(part))]))
    return _infix(found)


def _infix(found: list[Token]) -> Doc:
    parts: list[tuple[str, list[Token]]] = [("", [])]
    depth = 0
    for t in found:
        if not depth and _operator(t):
            parts.append((t.text, []))
            continue
        depth += (t.text in ("(", "[", "{") and t.kind == "sign") - (t.text in (")", "]", "}") and t.kind == "sign")
        parts[-1][1].append(t)
    if len(parts) == 1:
        return _application(found)
    return group(_application(parts[0][1]), indent(*[x for sign, part in parts[1:] for x in (SOFT, sign + " ", _application(part))]))


def _application(found: list[Token]) -> Doc:
    parts: list[Doc | str] = []
    at, flat = 0, []
    last: Token | None = None

    def flush() -> None:
        nonlocal flat
        if flat:
            parts.append(join(flat))
            flat = []

    while at < len(found):
        t = found[at]
        if t.kind == "sign" and t.text in ("(", "["):
            if flat:
                space = _space(flat[-1], t)
                flush()
                parts.append(" " if space else "")
            elif last is not None and _space(last, t):
                parts.append(" ")
            end = closing(found, at)
            inner = [p for _, p in _split(found[at + 1 : end], (",",))]
            if t.text == "(" and len(inner) > 1 and all(inner):
                parts.append(group("(", broken(" "), type_doc(inner[0]), indent(*[x for p in inner[1:] for x in (NIL, ", ", type_doc(p))], NIL, ")")))
            elif t.text == "[" and len(inner) == 1 and inner[0]:
                parts.append(group("[", indent(NIL, type_doc(inner[0])), NIL, "]"))
            elif len(inner) == 1 and inner[0]:
                parts.append(concat(t.text, type_doc(inner[0]), found[end].text))
            else:
                parts.append(join(found[at : end + 1]))
            last, at = found[end], end + 1
            continue
        if not flat and last is not None and _space(last, t):
            parts.append(" ")
        flat.append(t)
        last, at = t, at + 1
    flush()
    return concat(*parts)


def signature_doc(names: str, found: list[Token]) -> Doc:
    """``names :: type``; a type without arrows goes to a line of its own before it breaks inside."""
    arrows = _split(found, ("->", "=>"))
    if len(arrows) > 1:
        return concat(names, " :: ", type_doc(found))
    return group(names, " ::", indent(SOFT, type_doc(found)))


class _Projector:
    def __init__(self, path: str, source: str):
        self.source, self.path, self.keys, self.places = source, path, Keys(), Places(source)
        self.found = tokens(source, _form, ("{-", "-}"), _comment, _pragma)
        balanced(self.found, source)
        self.items: dict[str, list[Item]] = {"types": [], "signatures": [], "tests": []}

    def starts_line(self, i: int, found: list[Token]) -> bool:
        return i == 0 or "\n" in self.source[found[i - 1].end : found[i].start] or "\n" in found[i - 1].text

    def block(self, found: list[Token]) -> list[list[Token]]:
        """Declarations of a block: explicit braces, or tokens in the column of the first."""
        if not found:
            return []
        if found[0].text == "{" and closing(found, 0) == len(found) - 1:
            return [p for _, p in _split(found[1:-1], (";",)) if p]
        column = found[0].column
        at = [i for i, t in enumerate(found) if not i or t.column == column and self.starts_line(i, found)]
        low = next((t for i, t in enumerate(found) if t.column < column and self.starts_line(i, found)), None)
        if low is not None:
            raise ProjectionError("unexpected indentation", *_where(self.source, low.start))
        return [found[a:b] for a, b in zip(at, [*at[1:], len(found)], strict=True)]

    def emit(self, modes, kind, token, name, found, docs, container=None, parent=None, prefix=()):
        key = self.keys.new(f"{container or self.path}::{token}::{name}")
        (a, la, ca), (b, lb, cb) = self.places.of(found[0].start), self.places.of(found[-1].end)
        for mode in modes:
            doc = docs[mode] if isinstance(docs, dict) else docs
            self.items[mode].append(Item(key, parent, kind, name, a, b, la, ca, lb, cb, render(concat(*[x for p in prefix for x in (p.text, LINE)], doc))))
        return key

    def run(self) -> None:
        found, at, pragmas = self.found, 0, []
        while at < len(found) and found[at].text.startswith("{-#"):
            pragmas.append(found[at])
            at += 1
        if at < len(found) and found[at].text == "module":
            stop = next((i for i in range(at, len(found)) if found[i].text == "where"), None)
            if stop is None or at + 1 >= len(found):
                raise ProjectionError("expected where", *_where(self.source, found[at].start))
            name = found[at + 1].text
            self.emit(("types", "signatures"), "module", "module", name, found[at : stop + 1], text("module " + name), prefix=pragmas)
            at, pragmas = stop + 1, []
        declared = self.block(found[at:])
        signed = {n for d in declared for n in self.names(d)}
        for d in declared:
            if d[0].text.startswith("{-#"):
                own = [t for t in d if t.text.startswith("{-#")]
                pragmas += own
                d = d[len(own) :]
                if not d:
                    continue
            self.declaration(d, signed, pragmas)
            pragmas = []

    @staticmethod
    def names(d: list[Token]) -> list[str]:
        """Names that a signature covers; none for other declarations."""
        if d[0].text in ("type", "data", "newtype", "class", "instance", "foreign", "pattern", "deriving", "import", "default") or d[0].text in _FIXITY:
            return []
        left = _split(d, ("::",))
        equal = _split(d, ("=", "|"))
        if len(left) < 2 or len(equal) > 1 and len(equal[0][1]) < len(left[0][1]):
            return []
        return [join([t for t in part if t.text not in ("(", ")")]) for _, part in _split(left[0][1], (",",))]

    def declaration(self, d: list[Token], signed: set[str], pragmas: list[Token]) -> None:
        w, following = d[0].text, d[1].text if len(d) > 1 else ""
        both = ("types", "signatures")
        if w == "import" or w in _FIXITY or w == "pattern":
            return
        if w in ("type", "data") and following == "family":
            body = next((i for i, t in enumerate(d) if t.text == "where"), len(d))
            rows = [text(join(r)) for r in self.block(d[body + 1 :])]
            self.emit(both, "type_family", "family", d[2].text, d, concat(join(d[: body + 1]), indent(*[x for r in rows for x in (LINE, r)])), prefix=pragmas)
        elif w in ("type", "data", "newtype") and following == "instance":
            self.emit(both, "associated_type", "instance", d[2].text, d, text(join(d)), prefix=pragmas)
        elif w == "type" and following == "role":
            self.emit(both, "type", "role", d[2].text, d, text(join(d)), prefix=pragmas)
        elif w == "type":
            parts = _split(d, ("=",))
            if len(parts) == 1:
                sides = _split(d, ("::",))
                self.emit(both, "type", "kind", following, d, signature_doc(join(sides[0][1]), sides[1][1] if len(sides) > 1 else []), prefix=pragmas)
            else:
                self.emit(both, "type_alias", "alias", following, d, group(join(parts[0][1]), " =", indent(SOFT, type_doc(parts[1][1]))), prefix=pragmas)
        elif w in ("data", "newtype"):
            self.emit(both, "type", "type", self.head_name(d[1:]), d, self.data(d), prefix=pragmas)
        elif w == "deriving":
            at = next((i for i, t in enumerate(d) if t.text == "instance"), 0)
            self.emit(both, "trait_implementation", "deriving", self.head_name(d[at + 1 :]), d, text(join(d)), prefix=pragmas)
        elif w in ("class", "instance"):
            self.container(d, pragmas)
        elif w == "foreign":
            sides = _split(d, ("::",))
            if following == "import" and len(sides) > 1:
                self.emit(("signatures",), "function", "foreign", sides[0][1][-1].text, d, signature_doc(join(sides[0][1]), sides[1][1]), prefix=pragmas)
        else:
            made = self.value(d, signed)
            if made:
                kind, token, name, doc = made
                self.emit(("signatures",), kind, token, name, d, doc, prefix=pragmas)

    def value(self, d: list[Token], signed: set[str]) -> tuple[str, str, str, Doc] | None:
        """A signature, an unsigned function's head or an unsigned name."""
        if self.names(d):
            sides = _split(d, ("::",))
            left = join(sides[0][1])
            name = left if len(_split(sides[0][1], (",",))) == 1 else join(sides[1][1])
            return "function", "fn", name.strip("()"), signature_doc(left, sides[1][1])
        head = _split(d, ("=", "|"))[0][1]
        if len(_split(d, ("=", "|"))) == 1 or not head:
            return None
        name, kind, token = head[0].text, "value", "value"
        if len(head) > 1:
            kind, token = "function", "fn"
            infix = [t for t in head if _operator(t)]
            ticked = [i for i, t in enumerate(head) if t.text == "`"]
            if head[0].text == "(" and len(head) > 2 and _operator(head[1]) and head[2].text == ")":
                name = head[1].text
            elif infix and head[1] is infix[0]:
                name = infix[0].text
            elif ticked and ticked[0] == 1:
                name = head[2].text
            elif head[0].kind != "word" or head[0].text[0].isupper():
                return None  # a pattern, not a name
        return None if name in signed else (kind, token, name, text(join(head)))

    @staticmethod
    def head_name(found: list[Token]) -> str:
        """The first name behind a context."""
        depth = 0
        for i, t in enumerate(found):
            depth += (t.text in ("(", "[")) - (t.text in (")", "]"))
            if t.text in ("=", "where") and not depth:
                break
            if t.text == "=>" and not depth:
                found = found[i + 1 :]
                break
        return next((t.text for t in found if t.kind == "word"), "")

    def data(self, d: list[Token]) -> Doc:
        at = [i for i, t in enumerate(d) if t.text == "deriving" and self.top(d, i)]
        body, clauses = d[: at[0]] if at else d, [d[a:b] for a, b in zip(at, [*at[1:], len(d)], strict=False)]
        lines = [x for c in clauses for x in (LINE, join(c))]
        gadt = next((i for i, t in enumerate(body) if t.text == "where" and self.top(body, i)), None)
        if gadt is not None:
            members = []
            for m in self.block(body[gadt + 1 :]):
                sides = _split(m, ("::",))
                members += [LINE, signature_doc(join(sides[0][1]), sides[1][1]) if len(sides) > 1 else text(join(m))]
            return concat(join(body[: gadt + 1]), indent(*members, *lines))
        parts = _split(body, ("=",))
        if len(parts) == 1:
            return concat(join(body), indent(*lines))
        constructors = [p for _, p in _split(parts[1][1], ("|",))]
        head = join(parts[0][1])
        if d[0].text == "newtype" or len(constructors) == 1 and self.brace(constructors[0]) is not None:
            at_ = self.brace(constructors[0])
            if at_ is None:
                return concat(head, " = ", _application(constructors[0]), indent(*lines))
            return concat(head, " = ", join(constructors[0][:at_]), indent(LINE, *self.record(constructors[0], at_), *lines))
        rows: list[Doc | str] = []
        for i, c in enumerate(constructors):
            at_ = self.brace(c)
            rows += [LINE, "| " if i else "= ", _infix(c) if at_ is None else concat(join(c[:at_]), indent(LINE, *self.record(c, at_)))]
        return concat(head, indent(*rows, *lines))

    @staticmethod
    def top(found: list[Token], i: int) -> bool:
        return sum(t.text in ("(", "[", "{") for t in found[:i]) == sum(t.text in (")", "]", "}") for t in found[:i])

    @staticmethod
    def brace(found: list[Token]) -> int | None:
        return next((i for i, t in enumerate(found) if t.text == "{" and t.kind == "sign"), None)

    @staticmethod
    def record(found: list[Token], at: int) -> list[Doc | str]:
        fields, names = [], []
        for _, p in _split(found[at + 1 : closing(found, at)], (",",)):
            sides = _split(p, ("::",))
            names.append(join(sides[0][1]))
            if len(sides) > 1:
                fields.append(concat(", ".join(names), " :: ", type_doc(sides[1][1])))
                names = []
        if not fields:
            return ["{}"]
        return ["{ ", fields[0], *[x for f in fields[1:] for x in (LINE, ", ", f)], LINE, "}"]

    def container(self, d: list[Token], pragmas: list[Token]) -> None:
        at = next((i for i, t in enumerate(d) if t.text == "where" and self.top(d, i)), len(d))
        head, members = d[:at], self.block(d[at + 1 :])
        class_ = d[0].text == "class"
        name = self.head_name([t for t in head[1:] if not t.text.startswith("{-#")])
        token, kind = ("class", "trait") if class_ else ("instance", "trait_implementation")
        signed = {n for m in members for n in self.names(m)}
        rows: list[tuple[tuple[str, ...], str, list[Token], Doc]] = []
        for m in members:
            m = [t for t in m if not t.text.startswith("{-#")]
            if not m or m[0].text in _FIXITY:
                continue
            if m[0].text in ("type", "data", "newtype"):
                rows.append((("types", "signatures"), next((t.text for t in m[1:] if t.kind == "word" and t.text not in ("instance", "family")), ""), m, text(join(m))))
                continue
            made = self.value(m, signed)
            if made:
                rows.append((("signatures",), made[2], m, made[3]))
        docs = {}
        for mode in ("types", "signatures"):
            own = [doc for modes, _, _, doc in rows if mode in modes]
            docs[mode] = concat(join(head), *([" where", indent(*[x for doc in own for x in (LINE, doc)])] if own else []))
        key = self.emit(("types", "signatures"), kind, token, name, d, docs, prefix=pragmas)
        for modes, n, m, doc in rows:
            self.emit(modes, "method" if m[0].text not in ("type", "data", "newtype") else "associated_type", "method" if m[0].text not in ("type", "data", "newtype") else "instance", n, m, doc, key, key)


def project(path: str, source: str) -> dict[str, list[Item]]:
    """Items of each mode, in source order; tests have none. Raises ProjectionError for sources it cannot follow."""
    p = _Projector(path, source)
    p.run()
    return p.items
