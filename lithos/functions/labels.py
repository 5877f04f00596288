"""Labels that fit a number of columns, as column expressions: clipping, ellipses, paths and moves.

A wide character takes two columns, marks and controls none. Widths may be
columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAB = 4
_WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
_NONE = r"[\p{Mn}\p{Me}\p{Cc}\x{200B}-\x{200F}]"


def _int(value: int | Column) -> Column:
    return value.cast("int") if isinstance(value, Column) else F.lit(value)


def width(text: Column) -> Column:
    """Columns that a text takes."""
    return F.length(F.regexp_replace(text, _NONE, "")) + F.length(text) - F.length(F.regexp_replace(text, _WIDE, ""))


def first_line(text: Column) -> Column:
    """A text's first line without the blanks around it; the empty text for null."""
    return F.trim(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))


def expand_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit(" " * TAB))


def clip(text: Column, skip: int | Column, columns: int | Column) -> Column:
    """What stands in ``columns`` columns behind the first ``skip``; a wide character that only half fits is left out."""
    skip, columns = _int(skip), _int(columns)

    def step(state: Column, c: Column) -> Column:
        cells = F.when(c.rlike(_WIDE), 2).otherwise(F.when(c.rlike(_NONE), 0).otherwise(1))
        before = state["at"] < skip
        fits = ~before & (cells <= state["left"])
        # a negative rest means that something did not fit, and nothing follows it
        left = F.when(before, state["left"]).when(fits, state["left"] - cells).otherwise(-1)
        return F.struct((state["at"] + cells).alias("at"), left.alias("left"), F.when(fits, F.concat(state["out"], c)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), columns.alias("left"), F.lit("").alias("out"))
    made = F.aggregate(F.filter(F.split(expand_tabs(text), ""), lambda c: c != ""), start, step, lambda s: s["out"])
    return F.when(columns <= 0, "").otherwise(made)


def _last(text: Column, columns: Column) -> Column:
    return F.reverse(clip(F.reverse(text), 0, columns))


def _fitted(text: Column, columns: Column, else_: Column) -> Column:
    return F.when(columns <= 0, "").when(width(text) <= columns, text).when(columns == 1, "…").otherwise(else_)


def truncated(text: Column, columns: int | Column) -> Column:
    """A text cut at its end, with an ellipsis, where it is wider."""
    columns = _int(columns)
    return _fitted(text, columns, F.concat(clip(text, 0, columns - 1), F.lit("…")))


def shortened(text: Column, columns: int | Column) -> Column:
    """A text cut in its middle, with an ellipsis, where it is wider; of an even rest the end has more."""
    columns = _int(columns)
    head = F.floor((columns - 1) / 2).cast("int")
    return _fitted(text, columns, F.concat(clip(text, 0, head), F.lit("…"), _last(text, columns - 1 - head)))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _folder(path: Column) -> Column:
    """The path without its last component; null for a path of one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def elided_path(path: Column, columns: int | Column) -> Column:
    """A path that keeps its last component: its folders are cut first."""
    columns = _int(columns)
    name, folder = _name(path), _folder(path)
    rest = columns - width(name)
    head = F.rtrim(clip(folder, 0, F.greatest(rest - 3, F.lit(0))), F.lit("/"))
    cut = F.when(folder.isNull(), shortened(path, columns)).when(rest <= 0, shortened(name, columns)).when(rest < 2, name).when(head == "", F.concat(F.lit("…/"), name)).otherwise(F.concat(head, F.lit("/…/"), name))
    return F.when(columns <= 0, "").when(width(path) <= columns, path).otherwise(cut)


def move_label(old: Column, new: Column, whole: bool = False) -> Column:
    """From where to where a file moved: names alone inside one folder, else the whole old path; with ``whole`` the whole old path always."""
    inside = F.lit(False) if whole else _folder(old).eqNullSafe(_folder(new))
    return F.concat(F.when(inside, _name(old)).otherwise(old), F.lit(" → "), _name(new))


def fitted_move_label(old: Column, new: Column, columns: int | Column, whole: bool = False) -> Column:
    """``move_label`` in so many columns: the old folder goes first, then the middle of the old name, the new name last."""
    columns = _int(columns)
    full, names = move_label(old, new, whole), F.concat(_name(old), F.lit(" → "), _name(new))
    rest = columns - width(_name(new)) - 3
    return (
        F.when(columns <= 0, "").when(width(full) <= columns, full).when(width(names) <= columns, names)
        .when(rest > 0, F.concat(shortened(_name(old), rest), F.lit(" → "), _name(new)))
        .when(rest >= -1, F.concat(F.lit("→ "), _name(new)))
        .when(columns >= 6, F.concat(F.lit("→ "), shortened(_name(new), columns - 2)))
        .otherwise(shortened(_name(new), columns))
    )
