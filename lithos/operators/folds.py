"""Fold regions of declarations, which lines a mode shows, and the rows of a folded view."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators import nested
from lithos.plans.lineage import cut

#: Kinds whose regions start open where they are retained.
CONTAINERS = frozenset("module trait trait_implementation foreign_block".split())

_LINE = ("//", "--", "#")
_BLOCKS = (("/*", "*/"), ("{-", "-}"), ("#![", "]"), ("#[", "]"))
_literals = re.compile(r"""('[A-Za-z_]\w*(?!['\w]))|(?:br|rb|r)(#*)(["']).*?(?:\3\2|$)|"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)""")
#: Comments and marks that belong to what follows them.
_forward = re.compile(r"\s*(?:///|//!|/\*\*|/\*!|#!?\[|@|\{-#|\{-\|)")


@dataclass
class Region:
    """A declaration's lines, from 0; the region starts at its leading comments and attributes."""

    key: str
    parent: str | None
    kind: str
    retained: bool
    start: int
    declaration: int
    end: int
    level: int
    default_open: bool


def _bare(line: str) -> str:
    """The line with string and character literals blanked, also those that its end cuts off; lifetimes stay."""
    return _literals.sub(lambda m: m[0] if m[1] else " " * len(m[0]), line)


def _line_comment(line: str) -> bool:
    s = line.lstrip()
    if s.startswith("#"):
        return not s.startswith(("#[", "#![", "#-}"))
    return s.startswith(("//", "--"))


def _block_start(lines: list[str], end: int) -> int | None:
    """First line of the annotation block whose last line is ``end``; None if there is none."""
    line = lines[end]
    if not line.strip() or end == 0 and line.startswith("#!") and not line.startswith("#!["):
        return None
    if _line_comment(line):
        return end
    marks = [("(", ")", "@"), *((o, c, o) for o, c in _BLOCKS if c in _bare(line))]
    for open_, close, lead in marks:
        depth = 0
        for i in range(end, -1, -1):
            b = _bare(lines[i])
            depth += b.count(close) - b.count(open_)
            if depth <= 0:
                if depth == 0 and lines[i].lstrip().startswith(lead):
                    return i
                break
    return None


def fold_start(lines: list[str], start: int, other_above) -> int:
    """Climbs from a declaration over the annotation blocks that stand directly above it.

    Forms that belong to what follows (doc comments, attributes, decorators,
    pragmas) always attach; plain comments do not where the line above the
    block belongs to another declaration, which ``other_above`` tells of a line.
    """
    at = start
    while at > 0:
        block = _block_start(lines, at - 1)
        if block is None or block > 0 and not _forward.match(lines[block]) and other_above(block - 1):
            break
        at = block
    return at


def regions(items: list[dict], source: str) -> list[Region]:
    """Regions of a file's outline: items with stable_key, parent_key, kind, start_line, end_line, retained, in order."""
    lines = source.split("\n")
    parents = {i["stable_key"]: i["parent_key"] for i in items}

    def above(key: str) -> list[str]:
        out, at = [], parents.get(key)
        while at is not None and at not in out and at != key:
            out.append(at)
            at = parents.get(at)
        return out

    # a line's innermost declarations by a sweep: those that cover it and are not above the one at hand
    starts = sorted((i["start_line"], i["end_line"], n) for n, i in enumerate(items))
    first = [s for s, _, _ in starts]
    out = []
    for i in items:
        up = above(i["stable_key"])
        skip = {i["stable_key"], *up}

        def other(line: int, skip=skip) -> bool:
            # declarations nest, so those that cover a line stand close before it; parents bound the walk
            n = bisect_right(first, line) - 1
            while n >= 0:
                _, end, k = starts[n]
                if end >= line and items[k]["stable_key"] not in skip:
                    return True
                if items[k]["parent_key"] is None:
                    return False
                n -= 1
            return False

        start = fold_start(lines, i["start_line"], other)
        out.append(Region(i["stable_key"], i["parent_key"], i["kind"], i["retained"], start, i["start_line"], i["end_line"], len(up), bool(i["retained"]) and i["kind"] in CONTAINERS))
    return out


def visible_rows(found: list[Region], lines: int, mode: str, overrides: dict[str, bool] | None = None) -> list[tuple[str, int, int, str | None]]:
    """(row, first, last, key) of a folded view: row is source or fold. Overrides open (true) or close regions by key."""
    opened = {r.key: (overrides or {}).get(r.key, r.default_open) for r in found}
    begin: dict[int, list[Region]] = {}
    for r in sorted(found, key=lambda r: (r.start, r.level)):
        begin.setdefault(r.start, []).append(r)
    kept, dropped, marks = [0] * (lines + 1), [0] * (lines + 1), set()
    for r in found:
        cover = kept if r.retained else dropped
        cover[min(r.start, lines)] += 1
        cover[min(r.end + 1, lines)] -= 1
        if r.retained:
            marks |= {r.start, r.declaration, r.end}
    out: list[tuple[str, int, int, str | None]] = []
    a = b = 0
    covered = []
    for n in range(lines):
        a, b = a + kept[n], b + dropped[n]
        covered.append((a > 0, b > 0))
    at = 0
    while at < lines:
        here = begin.get(at, [])
        if mode == "tests":
            gone = next((r for r in here if not r.retained), None)
            if gone:
                at = gone.end + 1
                continue
        closed = next((r for r in here if not opened[r.key] and (mode == "signatures" or r.retained)), None)
        if closed:
            out.append(("fold", at, closed.end, closed.key))
            at = closed.end + 1
            continue
        yes, no = covered[at]
        if mode == "signatures" or mode == "types" and (yes and not no or at in marks) or mode == "tests" and yes:
            out.append(("source", at, at, None))
        at += 1
    return out


#: Rows of one Arrow batch, which holds those of many files.
BATCH_ROWS = 8192


def _by_file(by: list[str], listed: str, rows_of: Callable[[list[dict], str | None], list[tuple]], names: list[str], kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over files, each with a list and its ``_text``, that gives the rows ``rows_of`` makes of both behind the file's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []

            def made(batch=batch) -> pa.RecordBatch:
                own = batch.select(by).take(pa.array(of, pa.int64()))
                out = pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*by, *names])
                rows.clear()
                of.clear()
                return out

            for n, (items, source) in enumerate(zip(batch.column(listed).to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                own = rows_of(items, source)
                rows += own
                of += [n] * len(own)
                if len(rows) >= BATCH_ROWS:
                    yield made()
            if rows:
                yield made()

    return run


_ROW = "row_no int, row string, first_line int, last_line int, stable_key string, text string"


def visible(found: DataFrame, sources: DataFrame, key: list[str], mode: str, overrides: dict[str, bool] | None = None) -> DataFrame:
    """The rows of every file's folded view: the key, row_no from 0, row (source or fold), first and last line, the fold's key, the first line's text.

    ``found`` are regions as ``fold_regions`` gives them, in the outline's order;
    ``overrides`` open or close regions by key. A file's regions meet its text
    in one row.
    """
    by = list(dict.fromkeys([*key, "path"]))
    fields = [f.split(" ")[0] for f in _REGION.split(", ")]
    listed = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start_line", "level", *(f for f in fields if f not in ("start_line", "level"))))).alias("regions"))
    joined = sources.select(*by, F.col("text").alias("_text")).join(listed, by, "left")

    def rows_of(listed_: list[dict] | None, source: str | None) -> list[tuple]:
        own = [Region(r["stable_key"], r["parent_key"], r["kind"], r["retained"], r["start_line"], r["declaration_line"], r["end_line"], r["level"], r["default_open"]) for r in listed_ or ()]
        lines = (source or "").split("\n")
        if lines[-1] == "":
            lines.pop()
        return [(i, kind, a, b, k, lines[a]) for i, (kind, a, b, k) in enumerate(visible_rows(own, len(lines), mode, overrides))]

    schema = ", ".join(f"`{c}` {dict(joined.dtypes)[c]}" for c in by) + ", " + _ROW
    return joined.select(*by, "regions", "_text").mapInArrow(_by_file(by, "regions", rows_of, [c.split(" ")[0] for c in _ROW.split(", ")], [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]), schema)


_REGION = "stable_key string, parent_key string, kind string, retained boolean, start_line int, declaration_line int, end_line int, level int, default_open boolean"


def fold_regions(outline: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """One row per declaration with its region. ``outline`` has items with retained, ``sources`` the key, path and text.

    A file's items meet its text in one row, so no group is larger than a file.
    """
    by = list(dict.fromkeys([*key, "path"]))
    listed = outline.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "stable_key", "parent_key", "kind", "start_line", "end_line", "retained"))).alias("items"))
    joined = listed.join(sources.select(*by, F.col("text").alias("_text")), by)

    def rows_of(items: list[dict], source: str | None) -> list[tuple]:
        return [(r.key, r.parent, r.kind, r.retained, r.start, r.declaration, r.end, r.level, r.default_open) for r in regions(items, source or "")]

    schema = ", ".join(f"`{c}` {dict(joined.dtypes)[c]}" for c in by) + ", " + _REGION
    kinds = [pa.string()] * 3 + [pa.bool_()] + [pa.int32()] * 4 + [pa.bool_()]
    return joined.select(*by, "items", "_text").mapInArrow(_by_file(by, "items", rows_of, [c.split(" ")[0] for c in _REGION.split(", ")], kinds), schema)


def subtree_keys(found: DataFrame, key: list[str], root: str) -> DataFrame:
    """Keys below a region, itself left out: a join for each level that occurs, from the region downwards."""
    links = found.where("parent_key is not null and parent_key <> stable_key").select(*key, "stable_key", "parent_key")
    level = below = cut(links.where(F.col("parent_key") == root).select(*key, "stable_key"))
    while not level.isEmpty():
        under = links.join(level.withColumnRenamed("stable_key", "parent_key"), [*key, "parent_key"]).select(*key, "stable_key")
        level = cut(under.join(below, [*key, "stable_key"], "left_anti").where(F.col("stable_key") != root))
        below = cut(below.unionAll(level))
    return below


def deepest_at(found: DataFrame, key: list[str], line: int) -> DataFrame:
    """The innermost region at a line of each file."""
    return found.where((F.col("start_line") <= line) & (F.col("end_line") >= line)).groupBy(*key).agg(F.max_by("stable_key", F.struct("level", "start_line")).alias("stable_key"))


def neighbours(found: DataFrame, key: list[str]) -> DataFrame:
    """The next and the previous declaration of each, by start and then depth."""
    from pyspark.sql import Window

    order = Window.partitionBy(*key).orderBy("start_line", F.desc("level"), "stable_key")
    return found.select(*key, "stable_key", F.lead("stable_key").over(order).alias("next_key"), F.lag("stable_key").over(order).alias("previous_key"))


def fold_levels(found: DataFrame, key: list[str]) -> DataFrame:
    """The depth of folds at every line that a region covers: the key, line_no, fold_level from 1."""
    by = list(dict.fromkeys([*key, "path"]))
    lines = found.select(*by, "level", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    return lines.groupBy(*by, "line_no").agg((F.max("level") + 1).alias("fold_level"))


def opened(found: DataFrame, key: list[str], given: DataFrame) -> DataFrame:
    """Regions with ``default_open`` as ``given`` (stable_key, is_open) says for a region and all below it; the nearest region with a say decides, others keep their own."""
    by = list(dict.fromkeys([*key, "path"]))
    index = nested.nested_sets(found.select(*by, "stable_key", F.when(F.col("parent_key") != F.col("stable_key"), F.col("parent_key")).alias("parent_key"), "start_line"), by, ["start_line"])
    index = cut(index)
    said = nested.inherited(index, by, index.select(*by, "stable_key").join(given, "stable_key"), "is_open")
    return found.join(said, [*by, "stable_key"], "left").withColumn("default_open", F.coalesce("is_open", "default_open")).drop("is_open")


def closed_texts(found: DataFrame, rows: DataFrame, key: list[str], mode: str) -> DataFrame:
    """What a closed region shows: the key, path, stable_key, closed_text, suffix.

    ``found`` are regions of ``mode``, ``rows`` the item rows they come from. A region
    that the mode has shows the first line of its text there; another one its
    kind, name, the mode that hides it, and its signature's first line. The
    suffix tells how many lines are folded away.
    """
    by = list(dict.fromkeys([*key, "path", "stable_key"]))
    line = lambda c: F.trim(F.substring_index(c, "\n", 1))
    whole = rows.where((F.col("mode") == "signatures") & F.col("error").isNull()).select(*by, "name", F.col("canonical_text").alias("_signature"))
    own = rows.where((F.col("mode") == mode) & F.col("error").isNull()).select(*by, F.col("canonical_text").alias("_own"))
    met = found.join(whole, by).join(own, by, "left")
    hidden = F.concat_ws(" ", "kind", F.concat("name", F.lit(f" \u2014 hidden in {mode}  \u00b7 ")), line("_signature"))
    lines = F.col("end_line") - F.col("start_line")
    suffix = F.concat(F.lit("  \u22ef"), F.when(lines > 0, F.concat(F.lit(" "), lines.cast("string"), F.lit(" lines"))).otherwise(""), F.when(F.col("retained"), "").otherwise(f" hidden in {mode}"))
    return met.select(*by, F.when(F.col("retained"), line(F.coalesce("_own", "_signature"))).otherwise(hidden).alias("closed_text"), suffix.alias("suffix"))
