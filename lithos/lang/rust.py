"""Declarations of Rust sources, by a scanner for items and recursive layout of their token lists."""

from __future__ import annotations

import re
from dataclasses import replace

from lithos.functions.layout import LINE, SOFT, Doc, broken, concat, flat_width, group, indent, listing, render, reserve, text

from .items import Item, Keys, ProjectionError
from .scan import Places, Token, _where, balanced, closing, tokens

_form = re.compile(
    r"""(?P<string>(?:b|c)?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)|(?:b|c)?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])')|(?P<word>'[A-Za-z_]\w*|(?:r\#)?[^\W\d]\w*|\d\w*(?:\.\d\w*)?)|::|->|=>|\.\.=|\.\.\.|\.\.|==|!=|[-+*/%^&|=<>!?@.,;:\#$~()\[\]{}\\]"""
)
_TYPES = {"(": ")", "[": "]", "{": "}", "<": ">"}
_TESTS = frozenset(("test", "rstest", "test_case", "test_matrix"))
_SPACED_OPENER = frozenset((",", ";", ":", "=", "->", "+", "=>", "|", "dyn", "as", "in", "where", "mut", "const", "for", "impl"))
_MODIFIERS = frozenset("pub default async const unsafe extern safe".split())


def _space(a: Token | None, b: Token, before: Token | None) -> bool:
    """Whether a space stands between two tokens."""
    if a is None or b.text in (")", "]", ",", ";", ":", "::", ".", ">", "?") and not (b.text == "::" and a.text in ("=", ",", ":", "->", "<", "+", "&")):
        return b.text == "?" and a is not None and a.text in (":", "+", "=", ",")
    if b.text in ("<", "(", "["):
        return a.text in _SPACED_OPENER and not (a.text in ("for", "impl") and b.text == "<")
    if a.text in ("(", "[", "<", "&", "*", "::", ".", "#", "?", "!", "$"):
        return False
    if a.text == "-" and (before is None or before.text in ("(", ",", "=", "[", ";", "<", "|")):
        return False
    return True


def join(found: list[Token]) -> str:
    """Tokens with the spaces they need; a comma before ``>`` or at the end is dropped."""
    out = ""
    for i, t in enumerate(found):
        if t.text == "," and (i + 1 == len(found) or found[i + 1].text == ">"):
            continue
        a = found[i - 1] if i else None
        out += (" " if _space(a, t, found[i - 2] if i > 1 else None) else "") + t.text
    return out


def split(found: list[Token], sign: str) -> list[list[Token]]:
    """Parts between a sign outside all brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in found:
        if t.text == sign and not depth:
            out.append([])
            continue
        depth += (t.kind == "sign" and t.text in _TYPES) - (t.kind == "sign" and t.text in _TYPES.values())
        out[-1].append(t)
    return [x for x in out if x]


def type_doc(found: list[Token]) -> Doc:
    """A type or header: its bracketed lists may break, an element to a line."""
    parts: list[Doc | str] = []
    flat: list[Token] = []
    at, before, last = 0, None, None

    def flush() -> None:
        nonlocal flat
        if flat:
            parts.append(join(flat) if flat[-1].text != "," else join(flat) + ",")
            flat = []

    while at < len(found):
        t = found[at]
        if t.kind == "sign" and t.text in ("<", "("):
            end = closing(found, at, _TYPES)
            inner = split(found[at + 1 : end], ",")
            if last is not None and _space(last, t, before):
                flush()
                parts.append(" ")
            flush()
            single = t.text == "(" and len(inner) == 1 and found[end - 1].text == ","
            parts.append(listing(t.text, [type_doc(x) for x in inner], found[end].text) if not single else concat("(", type_doc(inner[0]), ",)"))
            before, last, at = t, found[end], end + 1
            continue
        if not flat and last is not None and _space(last, t, before):
            parts.append(" ")
        flat.append(t)
        before, last, at = last, t, at + 1
    flush()
    return concat(*parts)


def _attribute(found: list[Token]) -> Doc | None:
    """An outer attribute, None for documentation. ``found`` is what stands between the brackets."""
    if found and found[0].text == "doc":
        return None
    for i, t in enumerate(found):
        if t.text == "(":
            end = closing(found, i)
            if end == len(found) - 1:
                return concat("#[", join(found[:i]), reserve(1), listing("(", [text(join(x)) for x in split(found[i + 1 : end], ",")], ")"), reserve(-1), "]")
            break
    return text("#[" + join(found) + "]")


class _Head:
    """What stands before an item's own words."""

    def __init__(self):
        self.attributes: list[Doc] = []
        self.test = False

    def lines(self) -> list[Doc]:
        return [x for a in self.attributes for x in (a, LINE)]


class _Projector:
    def __init__(self, path: str, source: str):
        self.source, self.path, self.keys, self.places = source, path, Keys(), Places(source)
        self.found = tokens(source, _form, ("/*", "*/"), "//")
        balanced(self.found, source)
        self.items: dict[str, list[Item]] = {"types": [], "signatures": [], "tests": []}

    def fail(self, t: Token, what: str) -> ProjectionError:
        return ProjectionError(f"expected {what}", *_where(self.source, t.start))

    def emit(self, mode: str, key: str, parent: str | None, kind: str, name: str, a: Token, b: Token, doc: Doc) -> None:
        (s, ls, cs), (e, le, ce) = self.places.of(a.start), self.places.of(b.end)
        self.items[mode].append(Item(key, parent, kind, name, s, e, ls, cs, le, ce, render(doc)))

    def leaf(self, a, b, container, parent, kind, token, name, modes, doc):
        key = self.keys.new(f"{container}::{token}::{name}")
        for mode in modes:
            self.emit(mode, key, parent, kind, name, a, b, doc)
        return {m: doc for m in modes}

    def nest(self, a, b, key, parent, kind, name, make, members, modes):
        """A container: ``make`` turns member texts into its own; members are emitted behind it."""
        place = {m: len(self.items[m]) for m in self.items}
        inner = members()
        out = {}
        for mode, keeps_empty in modes.items():
            own = [d[mode] for d in inner if mode in d]
            if not own and not keeps_empty:
                continue
            rest = self.items[mode][place[mode] :]
            del self.items[mode][place[mode] :]
            out[mode] = make(own)
            self.emit(mode, key, parent, kind, name, a, b, out[mode])
            self.items[mode] += rest
        for mode in self.items:
            if mode not in out:
                del self.items[mode][place[mode] :]
        return out

    # -- items -----------------------------------------------------------------

    def body(self, at: int, end: int, container: str, parent: str | None, inside: str) -> list[dict[str, Doc]]:
        """Items between two places; inside is file, mod, trait, impl or extern."""
        out: list[dict[str, Doc]] = []
        head = _Head()
        while at < end:
            t = self.found[at]
            if t.text == "#":
                inner = self.found[at + 1].text == "!"
                open_ = at + (2 if inner else 1)
                close = closing(self.found, open_)
                within = self.found[open_ + 1 : close]
                if not inner:
                    doc = _attribute(within)
                    if doc is not None:
                        head.attributes.append(doc)
                    name = []
                    for x in within:
                        if x.kind != "word" and x.text != "::":
                            break
                        name.append(x.text)
                    head.test |= bool(name) and name[-1] in _TESTS
                at = close + 1
                continue
            if t.text == ";":
                at += 1
                continue
            at, made = self.item(at, end, container, parent, inside, head)
            if made:
                out.append(made)
            head = _Head()
        return out

    def until(self, at: int, end: int, stops: tuple[str, ...]) -> int:
        """The place of the next of ``stops`` outside brackets; braces count only if they are no stop."""
        while at < end:
            t = self.found[at]
            if t.kind == "sign":
                if t.text in stops:
                    return at
                if t.text in ("(", "[", "{"):
                    at = closing(self.found, at)
            at += 1
        return end

    def body_or_end(self, at: int, end: int) -> int:
        """The brace or semicolon that ends an item's head, where ``<`` and ``>`` are brackets of types."""
        depth = 0
        while at < end:
            t = self.found[at]
            if t.kind == "sign":
                if t.text in ("{", ";") and not depth:
                    return at
                if t.text in ("(", "[", "{"):
                    at = closing(self.found, at)
                else:
                    depth += (t.text == "<") - (t.text == ">")
            at += 1
        return end

    def skip(self, at: int, end: int) -> int:
        stop = self.until(at, end, (";", "{"))
        if stop < end and self.found[stop].text == "{":
            return closing(self.found, stop) + 1
        return min(stop + 1, end)

    def where(self, found: list[Token]) -> tuple[list[Token], list[Token]]:
        """Tokens before a where clause, and the clause."""
        depth = 0
        for i, t in enumerate(found):
            depth += (t.kind == "sign" and t.text in _TYPES) - (t.kind == "sign" and t.text in _TYPES.values())
            if t.text == "where" and not depth:
                return found[:i], found[i:]
        return found, []

    def item(self, at: int, end: int, container: str, parent: str | None, inside: str, head: _Head) -> tuple[int, dict[str, Doc] | None]:
        start = at
        words = self.found
        while at < end:
            w = words[at].text
            following = words[at + 1].text if at + 1 < end else ""
            if w == "pub":
                at += 1
                if following == "(":
                    at = closing(words, at) + 1
            elif w in ("async", "unsafe", "default", "safe") and words[at + 1].kind == "word":
                at += 1
            elif w == "const" and following in ("fn", "async", "unsafe", "extern"):
                at += 1
            elif w == "extern" and words[at + 1].kind == "string" and words[at + 2].text == "fn":
                at += 2
            elif w == "extern" and following == "fn":
                at += 1
            else:
                break
        if at >= end:
            return end, None
        w, following = words[at].text, words[at + 1] if at + 1 < end else None
        named = following is not None and following.kind == "word"
        if w in ("struct", "enum") and named or w == "union" and named and inside in ("file", "mod"):
            return self.data(start, at, end, container, parent, head, w)
        if w == "trait" and named or w == "impl":
            return self.members(start, at, end, container, parent, head, w)
        if w == "fn" and named:
            return self.function(start, at, end, container, parent, inside, head)
        if w == "type" and named:
            return self.alias(start, at, end, container, parent, inside, head)
        if w in ("const", "static") and named:
            stop = self.until(at, end, (";",))
            name = words[at + 2].text if following.text == "mut" else following.text
            text_end = self.until(at, stop, ("=",))
            doc = concat(*head.lines(), reserve(1), type_doc(words[start:text_end]), reserve(-1), ";")
            return stop + 1, self.leaf(words[start], words[min(stop, end - 1)], container, parent, "constant" if w == "const" else "static", w, name, ("signatures",), doc)
        if w == "mod" and named:
            stop = self.until(at, end, (";", "{"))
            if stop >= end or words[stop].text == ";":
                return stop + 1, None
            close = closing(words, stop)
            key = self.keys.new(f"{container}::mod::{following.text}")
            title = join(words[start:stop])
            return close + 1, self.nest(words[start], words[close], key, parent, "module", following.text, lambda own: _container(head, text(title), [], own), lambda: self.body(stop + 1, close, key, key, "mod"), {"types": False, "signatures": False, "tests": False}) or None
        if w == "extern" and (words[at + 1].text == "{" or words[at + 1].kind == "string" and words[at + 2].text == "{"):
            open_ = at + 1 if words[at + 1].text == "{" else at + 2
            close = closing(words, open_)
            abi = words[at + 1].text.strip('"') if open_ == at + 2 else "C"
            key = self.keys.new(f"{container}::extern::{abi}")
            title = join(words[start:open_])
            return close + 1, self.nest(words[start], words[close], key, parent, "foreign_block", abi, lambda own: _container(head, text(title), [], own), lambda: self.body(open_ + 1, close, key, key, "extern"), {"signatures": False}) or None
        return self.skip(at, end), None

    def data(self, start, at, end, container, parent, head, word):
        words = self.found
        name = words[at + 1].text
        key = self.keys.new(f"{container}::type::{name}")
        stop = self.body_or_end(at + 2, end)
        first, clause = self.where(words[start:stop])
        modes = {"types": True, "signatures": True}
        if word == "struct" and (stop >= end or words[stop].text == ";"):
            doc = concat(*head.lines(), reserve(0 if clause else 1), type_doc(first), reserve(0 if clause else -1), *_clause(clause), ";")
            return stop + 1, self.nest(words[start], words[min(stop, end - 1)], key, parent, "type", name, lambda own: doc, lambda: [], modes)
        close = closing(words, stop)
        fields = (lambda: self.variants(stop + 1, close, key)) if word == "enum" else (lambda: self.fields(stop + 1, close, key))
        return close + 1, self.nest(words[start], words[close], key, parent, "type", name, lambda own: _container(head, type_doc(first), clause, own), fields, modes)

    def parts(self, at: int, end: int) -> list[tuple[_Head, int, int]]:
        """Comma-parted members of a brace list with their attributes: head, first and last place."""
        out = []
        while at < end:
            head = _Head()
            while at < end and self.found[at].text == "#":
                close = closing(self.found, at + 1)
                doc = _attribute(self.found[at + 2 : close])
                if doc is not None:
                    head.attributes.append(doc)
                at = close + 1
            depth, stop, value = 0, at, False
            while stop < end:
                t = self.found[stop]
                if t.kind == "sign":
                    if t.text == "," and not depth:
                        break
                    if t.text in ("(", "[", "{"):
                        stop = closing(self.found, stop)
                    elif t.text == "=" and not depth:
                        value = True  # from here on < and > compare and shift, but for a path's types
                    elif t.text == "<":
                        depth += not value or depth > 0 or self.found[stop - 1].text == "::"
                    elif t.text == ">" and depth:
                        depth -= 1
                stop += 1
            if stop > at:
                out.append((head, at, stop))
            at = stop + 1
        return out

    def fields(self, at: int, end: int, key: str) -> list[dict[str, Doc]]:
        out = []
        for head, a, b in self.parts(at, end):
            name = next((self.found[i - 1].text for i in range(a + 1, b) if self.found[i].text == ":"), self.found[a].text)
            doc = concat(*head.lines(), reserve(1), type_doc(self.found[a:b]), reserve(-1), ",")
            self.leaf(self.found[a], self.found[b - 1], key, key, "field", "field", name, ("types", "signatures"), concat(*head.lines(), type_doc(self.found[a:b])))
            out.append({"types": doc, "signatures": doc})
        return out

    def variants(self, at: int, end: int, key: str) -> list[dict[str, Doc]]:
        out = []
        for head, a, b in self.parts(at, end):
            doc = self.variant(a, b)
            self.leaf(self.found[a], self.found[b - 1], key, key, "variant", "variant", self.found[a].text, ("types", "signatures"), concat(*head.lines(), doc))
            full = concat(*head.lines(), reserve(1), doc, reserve(-1), ",")
            out.append({"types": full, "signatures": full})
        return out

    def variant(self, a: int, b: int) -> Doc:
        if a + 1 < b and self.found[a + 1].text == "=":
            return text(join(_shifts(self.found[a:b])))
        if a + 1 < b and self.found[a + 1].text == "{":
            close = closing(self.found, a + 1)
            inner = [concat(*h.lines(), type_doc(self.found[x:y])) for h, x, y in self.parts(a + 2, close)]
            if not inner:
                return text(self.found[a].text + " {}")
            body = [x for i, d in enumerate(inner) for x in ((",", SOFT, d) if i else (d,))]
            return group(self.found[a].text, " {", indent(SOFT, *body), broken(","), SOFT, "}")
        return type_doc(self.found[a:b])

    def members(self, start, at, end, container, parent, head, word):
        words = self.found
        stop = self.body_or_end(at + 1, end)
        if stop >= end or words[stop].text == ";":
            return stop + 1, None
        close = closing(words, stop)
        first, clause = self.where(words[start:stop])
        if word == "trait":
            name = words[at + 1].text
            key, kind = self.keys.new(f"{container}::trait::{name}"), "trait"
            modes = {"types": True, "signatures": True}
        else:
            subject, _ = self.where(words[at + 1 : stop])
            if subject and subject[0].text == "<":
                subject = subject[closing(subject, 0, _TYPES) + 1 :]
            of = [i for i, t in enumerate(subject) if t.text == "for" and (i + 1 < len(subject) and subject[i + 1].text != "<")]
            name = join(subject[of[0] + 1 :] if of else subject)
            key, kind = self.keys.new("impl " + join(subject)), "trait_implementation"
            modes = {"types": bool(of), "signatures": bool(of)}
        made = self.nest(words[start], words[close], key, parent, kind, name, lambda own: _container(head, type_doc(first), clause, own), lambda: self.body(stop + 1, close, key, key, word), modes)
        return close + 1, made or None

    def function(self, start, at, end, container, parent, inside, head):
        words = self.found
        name = words[at + 1].text
        open_ = at + 2
        if words[open_].text == "<":
            open_ = closing(words, open_, _TYPES) + 1
        if open_ >= end or words[open_].text != "(":
            raise self.fail(words[min(open_, end - 1)], "parameters")
        close = closing(words, open_)
        stop = self.body_or_end(close + 1, end)
        last = closing(words, stop) if stop < end and words[stop].text == "{" else min(stop, end - 1)
        after, clause = self.where(words[close + 1 : stop])
        returns = concat(" ", type_doc(after)) if after else concat()
        params = [self.parameter(self.found[a:b], h) for h, a, b in self.parts(open_ + 1, close)]
        tail = 0 if clause else 1
        rest = (flat_width(returns) or 0) + tail
        doc = concat(*head.lines(), join(words[start:open_]), reserve(rest), listing("(", params, ")"), reserve(-rest), reserve(tail), returns, reserve(-tail), *_clause(clause), ";")
        method = inside in ("trait", "impl")
        modes = ("signatures", "tests") if head.test and not method else ("signatures",)
        return last + 1, self.leaf(words[start], words[last], container, parent, "method" if method else "function", "method" if method else "fn", name, modes, doc)

    def parameter(self, found: list[Token], head: _Head) -> Doc:
        depth = 0
        for i, t in enumerate(found):
            depth += (t.kind == "sign" and t.text in _TYPES) - (t.kind == "sign" and t.text in _TYPES.values())
            if t.text == ":" and not depth:
                return concat(*[x for a in head.attributes for x in (a, " ")], join(found[:i]), ": ", type_doc(found[i + 1 :]))
        return concat(*[x for a in head.attributes for x in (a, " ")], join(found))

    def alias(self, start, at, end, container, parent, inside, head):
        words = self.found
        stop = self.until(at, end, (";",))
        equal = self.until(at, stop, ("=",))
        left, before = self.where(words[start:equal])
        right, behind = self.where(words[equal + 1 : stop]) if equal < stop else ([], [])
        clause = before or behind
        tail = 0 if clause else 1
        doc = concat(*head.lines(), reserve(tail), type_doc(left), *([" = ", type_doc(right)] if right else []), reserve(-tail), *_clause(clause), ";")
        member = inside in ("trait", "impl")
        kind, token = ("associated_type", "assoc_type") if member else ("type_alias", "alias")
        modes = ("signatures",) if inside == "extern" else ("types", "signatures")
        return stop + 1, self.leaf(words[start], words[min(stop, end - 1)], container, parent, kind, token, words[at + 1].text, modes, doc)


def _shifts(found: list[Token]) -> list[Token]:
    """Two angle brackets of one kind without a gap, outside a path's types, are one sign."""
    out: list[Token] = []
    depth = 0
    for t in found:
        before = out[-1] if out else None
        if t.text == "<" and (depth or before is not None and before.text == "::"):
            depth += 1
        elif t.text == ">" and depth:
            depth -= 1
        elif t.text in ("<", ">") and before is not None and before.text == t.text and not t.gap:
            out[-1] = replace(before, text=2 * t.text, end=t.end)
            continue
        out.append(t)
    return out


def _clause(found: list[Token]) -> list[Doc | str]:
    return [LINE, join(found).rstrip(",")] if found else []


def _container(head: _Head, title: Doc, clause: list[Token], own: list[Doc]) -> Doc:
    open_ = [*_clause(clause), LINE, "{"] if clause else [" {"]
    if not own:
        return concat(*head.lines(), reserve(3), title, reserve(-3), *open_, "}")
    return concat(*head.lines(), reserve(0 if clause else 2), title, reserve(0 if clause else -2), *open_, indent(*[x for d in own for x in (LINE, d)]), LINE, "}")


def project(path: str, source: str) -> dict[str, list[Item]]:
    """Items of each mode, in source order. Raises ProjectionError for sources it cannot follow."""
    p = _Projector(path, source)
    p.body(0, len(p.found), path, None, "file")
    return p.items
