"""Declarations of Python sources. The standard library parses; text is laid out anew from tokens."""

from __future__ import annotations

import ast
import io
import tokenize
from bisect import bisect_left

from lithos.functions.layout import LINE, Doc, concat, flat_width, group, indent, listing, render, reserve, text

from .items import Item, Keys, ProjectionError

_ENUMS = frozenset(("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "EnumMeta"))
_TYPE_CALLS = frozenset(("TypeVar", "ParamSpec", "TypeVarTuple", "NewType"))
_CLOSERS, _OPENERS = frozenset(") ] } , ; : .".split()), frozenset("( [ {".split())
_BEFORE_OPENER = frozenset((",", ";", ":", "=", "->", "|", "in", "and", "or", "not", "if", "else", "is", "lambda", "+", "-", "/", "==", "<", ">", "await", "for"))
_TIGHT = frozenset(("(", "[", "{", ".", "*", "**", "@", "~"))


class _Source:
    def __init__(self, source: str):
        try:
            self.tree = ast.parse(source, type_comments=False)
            tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
        except (SyntaxError, tokenize.TokenError, IndentationError) as e:
            where = getattr(e, "lineno", None), getattr(e, "offset", None)
            raise ProjectionError(f"not Python: {e.args[0] if e.args else e}", *where) from e
        except ValueError as e:
            raise ProjectionError(f"not Python: {e}") from e
        self.lines = source.splitlines(keepends=True) or [""]
        self.offsets = [0]
        for line in self.lines:
            self.offsets.append(self.offsets[-1] + len(line.encode()))
        drop = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
        self.tokens = [(self.byte(t.start[0], len(self.lines[t.start[0] - 1][: t.start[1]].encode()) if t.start[0] <= len(self.lines) else 0), t.string, t.type) for t in tokens if t.type not in drop]
        self.starts = [t[0] for t in self.tokens]

    def byte(self, line: int, column: int) -> int:
        return self.offsets[min(line - 1, len(self.offsets) - 1)] + column

    def range(self, node: ast.AST) -> tuple[int, int]:
        return self.byte(node.lineno, node.col_offset), self.byte(node.end_lineno, node.end_col_offset)

    def words(self, start: int, end: int) -> list[tuple[str, int]]:
        return [(s, kind) for _, s, kind in self.tokens[bisect_left(self.starts, start) : bisect_left(self.starts, end)]]


def _join(words: list[tuple[str, int]]) -> str:
    """Tokens with the spaces they need; ``=`` is glued inside brackets."""
    out, depth, previous, before, verbatim = "", 0, "", "", 0
    for s, kind in words:
        if kind == tokenize.FSTRING_END:
            verbatim -= 1
        if not out or verbatim or kind == tokenize.FSTRING_END:
            space = False
        elif s in _CLOSERS:
            space = False
        elif s in _OPENERS:
            space = previous in _BEFORE_OPENER
        elif previous in ("*", "**", "-", "~", "+") and (before in ("", "(", "[", "{", ",", "=", ":", "->", "*", "return", "lambda") or before in _BEFORE_OPENER):
            space = False
        elif previous in ("(", "[", "{", ".", "@", "~"):
            space = False
        elif "=" in (s, previous) and depth:
            space = False
        else:
            space = True
        out += (" " if space else "") + s
        if kind == tokenize.FSTRING_START:
            verbatim += 1
        depth += (s in _OPENERS) - (s in (")", "]", "}"))
        before, previous = previous, s
    return out


class _Projector:
    def __init__(self, path: str, source: str):
        self.source, self.path, self.keys = _Source(source), path, Keys()
        self.items: dict[str, list[Item]] = {m: [] for m in ("types", "signatures", "tests")}

    # -- text ----------------------------------------------------------------

    def plain(self, node: ast.AST) -> str:
        words = self.source.words(*self.source.range(node))
        while len(words) > 1 and words[-1][0] == ",":
            words.pop()
        return _join(words)

    def value(self, node: ast.expr) -> Doc:
        if isinstance(node, (ast.List, ast.Set)):
            a, b = ("[", "]") if isinstance(node, ast.List) else ("{", "}")
            return listing(a, [self.value(x) for x in node.elts], b)
        if isinstance(node, ast.Dict):
            return listing("{", [concat("**", self.value(v)) if k is None else concat(self.value(k), ": ", self.value(v)) for k, v in zip(node.keys, node.values, strict=True)], "}")
        if isinstance(node, ast.Tuple) and len(node.elts) != 1 and self.source.words(*self.source.range(node))[:1] == [("(", tokenize.OP)]:
            return listing("(", [self.value(x) for x in node.elts], ")")
        if isinstance(node, ast.Call) and not (len(node.args) == 1 and isinstance(node.args[0], ast.GeneratorExp)):
            return concat(self.value(node.func), listing("(", self.arguments(node.args, node.keywords), ")"))
        if isinstance(node, ast.Subscript) and not self.sliced(node.slice):
            return self.type(node)
        if isinstance(node, ast.Starred):
            return concat("*", self.value(node.value))
        return text(self.plain(node))

    @staticmethod
    def sliced(node: ast.expr) -> bool:
        return isinstance(node, ast.Slice) or isinstance(node, ast.Tuple) and (len(node.elts) < 2 or any(isinstance(x, ast.Slice) for x in node.elts))

    def arguments(self, args: list[ast.expr], keywords: list[ast.keyword]) -> list[Doc]:
        both = sorted([*((self.source.range(a)[0], self.value(a)) for a in args), *((self.source.range(k)[0], concat("**" if k.arg is None else f"{k.arg}=", self.value(k.value))) for k in keywords)], key=lambda x: x[0])
        return [d for _, d in both]

    def type(self, node: ast.expr) -> Doc:
        if isinstance(node, ast.Subscript) and not self.sliced(node.slice):
            parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            return concat(self.type(node.value), listing("[", [self.type(p) for p in parts], "]"))
        if isinstance(node, ast.List):
            return listing("[", [self.type(p) for p in node.elts], "]")
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            return concat(self.type(node.left), " | ", self.type(node.right))
        if isinstance(node, ast.Call):
            return self.value(node)
        return text(self.plain(node))

    def parameters(self, a: ast.arguments) -> list[Doc]:
        out: list[Doc] = []

        def one(p: ast.arg, default: ast.expr | None, star: str = "") -> Doc:
            if p.annotation is not None:
                parts: list = [star + p.arg, ": ", self.type(p.annotation)]
                return concat(*parts, *([" = ", self.value(default)] if default is not None else []))
            return concat(star + p.arg, *(["=", self.value(default)] if default is not None else []))

        positional = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)
        for i, (p, d) in enumerate(zip(positional, defaults, strict=True)):
            out.append(one(p, d))
            if a.posonlyargs and i == len(a.posonlyargs) - 1:
                out.append(text("/"))
        if a.vararg:
            out.append(one(a.vararg, None, "*"))
        elif a.kwonlyargs:
            out.append(text("*"))
        out += [one(p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        if a.kwarg:
            out.append(one(a.kwarg, None, "**"))
        return out

    def type_parameters(self, node: ast.AST) -> str:
        params = getattr(node, "type_params", None)
        return "[" + ", ".join(self.plain(p) for p in params) + "]" if params else ""

    def decorators(self, node: ast.AST) -> list[Doc]:
        return [part for d in node.decorator_list for part in (concat("@", self.value(d)), LINE)]

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> Doc:
        head = ("async def " if isinstance(node, ast.AsyncFunctionDef) else "def ") + node.name + self.type_parameters(node)
        returns = concat(" -> ", self.type(node.returns)) if node.returns is not None else concat()
        rest = (flat_width(returns) or 0) + len(": ...")
        params = self.parameters(node.args)
        tail = [reserve(len(": ...")), group(returns), reserve(-len(": ...")), ": ..."]
        body = [reserve(rest), listing("(", params, ")"), reserve(-rest)] if params else ["()"]
        return concat(*self.decorators(node), head, *body, *tail)

    # -- declarations ----------------------------------------------------------

    def emit(self, mode: str, key: str, parent: str | None, kind: str, name: str, node: ast.AST, doc: Doc) -> None:
        start, end = self.source.range(node)
        self.items[mode].append(Item(key, parent, kind, name, start, end, node.lineno - 1, node.col_offset, node.end_lineno - 1, node.end_col_offset, render(doc)))

    def body(self, nodes: list[ast.stmt], container: str, parent: str | None, in_class: bool, enum: bool) -> list[tuple[set[str], dict[str, Doc]]]:
        """Members that stay: the modes of each, and its text by mode."""
        out = []
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                out += self.klass(node, container, parent)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                modes = {"signatures"} | ({"tests"} if node.name.startswith("test_") else set())
                out.append(self.leaf(node, container, parent, "method" if in_class else "function", "method" if in_class else "fn", node.name, modes, self.function(node)))
            elif isinstance(node, ast.TypeAlias):
                doc = concat("type ", self.plain(node.name) + self.type_parameters(node), " = ", self.type(node.value))
                out.append(self.leaf(node, container, parent, "type_alias", "alias", node.name.id, {"types", "signatures"}, doc))
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                doc = concat(node.target.id, ": ", self.type(node.annotation))
                out.append(self.leaf(node, container, parent, "field" if in_class else "value", "field" if in_class else "value", node.target.id, {"types", "signatures"} if in_class else {"signatures"}, doc))
            elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                name, called = node.targets[0].id, node.value.func if isinstance(node.value, ast.Call) else None
                if isinstance(called, (ast.Name, ast.Attribute)) and (called.id if isinstance(called, ast.Name) else called.attr) in _TYPE_CALLS:
                    out.append(self.leaf(node, container, parent, "type", "type", name, {"types", "signatures"}, concat(name, " = ", self.value(node.value))))
                elif enum:
                    out.append(self.leaf(node, container, parent, "variant", "variant", name, {"types", "signatures"}, text(name)))
                else:
                    out.append(self.leaf(node, container, parent, "value", "value", name, {"signatures"}, text(name)))
        return out

    def leaf(self, node, container, parent, kind, token, name, modes, doc):
        key = self.keys.new(f"{container}::{token}::{name}")
        for mode in modes:
            self.emit(mode, key, parent, kind, name, node, doc)
        return modes, {m: doc for m in modes}

    def klass(self, node: ast.ClassDef, container: str, parent: str | None):
        key = self.keys.new(f"{container}::class::{node.name}")
        place = {m: len(self.items[m]) for m in self.items}
        enum = any((b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else "") in _ENUMS for b in node.bases)
        members = self.body(node.body, key, key, True, enum)
        bases = self.arguments(node.bases, node.keywords)
        modes, docs = set(), {}
        for mode in self.items:
            own = [d[mode] for m, d in members if mode in m]
            if mode == "tests" and not own:
                continue
            head = concat(*self.decorators(node), f"class {node.name}{self.type_parameters(node)}", *([reserve(5), listing("(", bases, ")"), reserve(-5)] if bases else []), ":")
            doc = concat(head, indent(*[p for d in own for p in (LINE, d)])) if own else concat(head, " ...")
            modes.add(mode)
            docs[mode] = doc
            rest = self.items[mode][place[mode] :]
            del self.items[mode][place[mode] :]
            self.emit(mode, key, parent, "type", node.name, node, doc)
            self.items[mode] += rest
        return [(modes, docs)]


def project(path: str, source: str) -> dict[str, list[Item]]:
    """Items of each mode, in source order. Raises ProjectionError for a source that does not parse."""
    p = _Projector(path, source)
    p.body(p.source.tree.body, path, None, False, False)
    return p.items
