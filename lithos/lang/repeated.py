"""Sources of which every line is a function by itself: each distinct line is parsed once, however often it stands anywhere.

A line that parses alone, at the margin and without comments, attributes or
continuations, parses to the same within such a file; only its place and the
number behind a repeated key depend on the lines around it. Lines that differ
in the function's name alone parse to the same but for that name, if it is as
long and no word of the language; so many files at once, as columns, need one
parse for each kind of line.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .items import Item, Keys, ProjectionError

#: What a line must look like, in printable ASCII; anything else goes to the whole projector.
_FORMS = {"python": re.compile(r"def (?:[ -~](?<![#\"\\]))+"), "rust": re.compile(r"(?:pub )?fn (?:[ -~](?<![#/\"'\\]))*[;}]")}
#: Lines that a worker remembers, the latest ones, and the longest of them.
_MOST, _LONGEST = 1 << 17, 500
#: A line's beginning, the function's name and the rest.
_NAMED = {language: f"^(?P<begin>{begin} )(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?P<rest>[^A-Za-z0-9_].*)$" for language, begin in (("python", "def"), ("rust", "(?:pub )?fn"))}
#: Names that may mean something to a projector, as names that begin with test_ do.
_WORDS = pa.array([*keyword.kwlist, *keyword.softkwlist, "__debug__", *"abstract as async auto await become box break const continue crate default do dyn else enum extern false final fn for gen if impl in let loop macro macro_rules match mod move mut override priv pub raw ref return safe self Self static struct super trait true try type typeof union unsafe unsized use virtual where while yield".split()])
#: Rows of one set of columns.
_ROWS = 1 << 15


@lru_cache(_MOST)
def _alone(project: Callable, line: str) -> dict[str, Item] | None:
    """The function that a line declares, by mode; None unless it declares that and nothing else."""
    try:
        found = {mode: own for mode, own in project("", line).items() if own}
    except (ProjectionError, RecursionError):
        return None
    one = found.get("signatures", [None])[0]
    fits = one is not None and all(len(own) == 1 and own[0].parent_key is None and own[0].stable_key == f"::fn::{one.name}" for own in found.values())
    return {mode: own[0] for mode, own in found.items()} if fits else None


@lru_cache(_MOST)
def _renamed(project: Callable, language: str, begin: str, size: int, rest: str) -> dict[str, tuple[Item, str, str]] | None:
    """The function of a line whose name has ``size`` letters, by mode, with the texts before and after its name; None where that cannot be told."""
    name = next((c * size for c in "qzjxkvwy" if c * size not in begin + rest), None)
    found = name and _FORMS[language].fullmatch(begin + name + rest) and _alone(project, begin + name + rest)
    if not found or any(i.name != name or i.stable_key != f"::fn::{name}" or i.canonical_text.count(name) != 1 for i in found.values()):
        return None
    return {mode: (i, *i.canonical_text.split(name)) for mode, i in found.items()}


def _kinds(project: Callable, language: str, lines: pa.Array) -> tuple[np.ndarray, list[dict[str, tuple[Item, str, str]]], pa.Array, pa.Array]:
    """Of distinct lines the number of their kind (-1 for a line that is no function by itself), the kinds, the functions' names and what stands between a kind's texts."""
    begin, name, rest = pc.extract_regex(lines, _NAMED[language]).flatten()
    other = pc.or_kleene(pc.or_kleene(pc.is_null(name), pc.is_in(name, _WORDS)), pc.starts_with(name, "test_"))
    plain = np.flatnonzero(~other.to_numpy(zero_copy_only=False) & (pc.binary_length(lines).to_numpy() <= _LONGEST))
    kind, kinds = np.full(len(lines), -1), []
    if len(plain):
        b, r = (x.take(pa.array(plain)).dictionary_encode() for x in (begin, rest))
        sizes = pc.binary_length(name.take(pa.array(plain))).to_numpy().astype(np.int64)
        kept = (b.indices.to_numpy().astype(np.int64) * len(r.dictionary) + r.indices.to_numpy()) * (_LONGEST + 1) + sizes
        _, first, which = np.unique(kept, return_index=True, return_inverse=True)
        numbers = []
        for n in first.tolist():
            found = _renamed(project, language, b[n].as_py(), int(sizes[n]), r[n].as_py())
            numbers.append(len(kinds) if found else -1)
            kinds += [found] if found else []
        kind[plain] = np.array(numbers)[which]
    own = kind < 0
    names = []
    for n, line in zip(np.flatnonzero(own).tolist(), lines.filter(pa.array(own)).to_pylist(), strict=True):
        found = _alone(project, line) if len(line) <= _LONGEST and _FORMS[language].fullmatch(line) else None
        names.append(found["signatures"].name if found else None)
        if found:
            kind[n] = len(kinds)
            kinds.append({mode: (i, i.canonical_text, "") for mode, i in found.items()})
    return kind, kinds, pc.replace_with_mask(name, pa.array(own), pa.array(names, pa.string())), pc.if_else(pa.array(own), "", name)


def may_be(language: str, source: str) -> bool:
    """Whether ``by_columns`` should be asked about a source: its first line has the form."""
    return language in _FORMS and _FORMS[language].fullmatch(source[: _LONGEST + 1].split("\n", 1)[0]) is not None


def _again(file: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many earlier places of the same file have the same key. Files come one after the other."""
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(file[order]) != 0)
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def by_columns(project: Callable, language: str, paths: list[str], sources: list[str], modes: Sequence[str], columns: Sequence[str]) -> tuple[list[int], Iterator[tuple[np.ndarray, list[pa.Array]]]]:
    """The numbers of sources that are not made of such lines, and the items of the others as ``project`` gives them, in portions: each row's source, and ``columns``."""
    split = pc.split_pattern(pa.array([s.removesuffix("\n") for s in sources], pa.large_string()), "\n")
    starts, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    code, lines = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
    kind, kinds, names, between = _kinds(project, language, lines)
    known = kind >= 0
    whole = np.logical_and.reduceat(known[code], starts[:-1])
    count = np.diff(starts)
    file = np.repeat(np.arange(len(sources)), count)
    length = pc.binary_length(lines).to_numpy().astype(np.int64)[code] + 1
    end = np.cumsum(length)
    at = end - length
    at -= at[starts[:-1]][file]
    again = _again(file, pc.fill_null(names, "").dictionary_encode().indices.to_numpy().astype(np.int64)[code])
    place = np.arange(len(code)) - starts[:-1][file]

    def portions() -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        path_of, behind = pa.array(paths, pa.string()), pa.array(["", *(f"~{n}" for n in range(1, again.max(initial=0) + 1))])
        keys = pc.binary_join_element_wise("::fn::", names, "")
        for mode in modes:
            of = [k.get(mode) for k in kinds]
            has = known & np.array([*(o is not None for o in of), False])[kind]
            rows = np.flatnonzero(has[code] & whole[file])
            if not len(rows):
                continue
            before, after, what = (pa.array([o and x(o) for o in of], pa.string()) for x in (lambda o: o[1], lambda o: o[2], lambda o: o[0].kind))
            of_kind = pa.array(kind, mask=~has)
            texts, what = pc.binary_join_element_wise(before.take(of_kind), between, after.take(of_kind), ""), what.take(of_kind)
            spans = {c: np.array([o and getattr(o[0], c) or 0 for o in of])[kind] for c in ("start_byte", "end_byte", "start_column", "end_column")}
            ordinal = np.arange(len(rows)) - np.searchsorted(rows, starts[:-1])[file[rows]]
            for n in range(0, len(rows), _ROWS):
                part = rows[n : n + _ROWS]
                own, owner, line = code[part], file[part], pa.array(place[part], pa.int32())
                made = {
                    "mode": lambda: pa.repeat(mode, len(part)),
                    "ordinal": lambda: pa.array(ordinal[n : n + _ROWS], pa.int32()),
                    "stable_key": lambda: pc.binary_join_element_wise(path_of.take(pa.array(owner)), keys.take(pa.array(own)), behind.take(pa.array(again[part])), ""),
                    "parent_key": lambda: pa.nulls(len(part), pa.string()),
                    "kind": lambda: what.take(pa.array(own)),
                    "name": lambda: names.take(pa.array(own)),
                    "start_byte": lambda: pa.array(at[part] + spans["start_byte"][own], pa.int32()),
                    "end_byte": lambda: pa.array(at[part] + spans["end_byte"][own], pa.int32()),
                    "start_line": lambda: line,
                    "start_column": lambda: pa.array(spans["start_column"][own], pa.int32()),
                    "end_line": lambda: line,
                    "end_column": lambda: pa.array(spans["end_column"][own], pa.int32()),
                    "canonical_text": lambda: texts.take(pa.array(own)),
                    "error": lambda: pa.nulls(len(part), pa.string()),
                }
                yield owner, [made[c]() for c in columns]

    return np.flatnonzero(~whole).tolist(), portions()


def by_line(project: Callable, language: str, path: str, source: str) -> dict[str, list[Item]] | None:
    """Items of every mode as ``project`` gives them; None for a source that is not made of such lines."""
    form, lines = _FORMS.get(language), source.removesuffix("\n").split("\n")
    if form is None or not all(len(line) <= _LONGEST and form.fullmatch(line) for line in lines):
        return None
    out, keys, at = {m: [] for m in ("types", "signatures", "tests")}, Keys(), 0
    for n, line in enumerate(lines):
        found = _alone(project, line)
        if found is None:
            return None
        key = keys.new(path + found["signatures"].stable_key)
        for mode, i in found.items():
            out[mode].append(Item(key, None, i.kind, i.name, at + i.start_byte, at + i.end_byte, n, i.start_column, n, i.end_column, i.canonical_text))
        at += len(line) + 1
    return out
