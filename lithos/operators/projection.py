"""Declarations of source files as rows: one parse for all modes, then native joins and text assembly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.lang import elm, haskell, python, repeated, rust
from lithos.lang.items import MODES, Item, ProjectionError, check

Projector = Callable[[str, str], dict[str, list[Item]]]
#: Projector by language: takes a path and a source, returns the items of every mode.
PROJECTORS: dict[str, Projector] = {"elm": elm.project, "haskell": haskell.project, "python": python.project, "rust": rust.project}

_COLUMNS = ["stable_key", "parent_key", "kind", "name", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column", "canonical_text"]
SCHEMA = "mode string, ordinal int, stable_key string, parent_key string, kind string, name string, start_byte int, end_byte int, start_line int, start_column int, end_line int, end_column int, canonical_text string, error string"
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int32(), *[pa.string()] * 4, *[pa.int32()] * 6, pa.string(), pa.string()]


def project_source(path: str, content: bytes | str, language: str, mode: str | None = None) -> dict[str, list[Item]] | list[Item]:
    """The items of one source, of every mode or of one. Raises ProjectionError."""
    if language not in PROJECTORS:
        raise ProjectionError(f"no projector for {language}")
    try:
        text = content.decode() if isinstance(content, bytes) else content
    except UnicodeDecodeError as e:
        raise ProjectionError(f"not UTF-8 at byte {e.start}") from e
    items = repeated.by_line(PROJECTORS[language], language, path, text) or PROJECTORS[language](path, text)
    for found in items.values():
        check(found)
    return items if mode is None else items[mode]


#: Rows of one Arrow batch of items.
BATCH_ROWS = 4096
#: Files that are looked at together, and letters of those that go together as columns.
_FILES, _LETTERS = 64, 1 << 23


def items(files: DataFrame, key: list[str], path: str = "path", language: str = "language", content: str = "text", marked: bool = False, modes: Sequence[str] = MODES, columns: Sequence[str] | None = None, dealt: bool = False) -> DataFrame:
    """One row per item and mode: the key, path, language and the item; a file that fails has one row with only ``error``.

    ``marked`` gives a file without items a row that says nothing else. Only
    ``modes`` and, of the item, only ``columns`` and the error are given.
    ``dealt`` says that the files are dealt to all tasks already.

    Equal (path, content) should be given once, as ``store`` does; the parse is
    the cost, so files are dealt to all tasks before it, however they lie. Files
    of languages without a projector are left out.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []
            waiting: dict[str, list[tuple[int, str, str]]] = {}
            letters: Counter[str] = Counter()

            def table(of, own, batch=batch) -> pa.RecordBatch:
                kept = batch.select(own_names).take(pa.array(of, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, *own], names=[*own_names, *names])

            def made() -> pa.RecordBatch:
                out = table(of, [pa.array(c, t) for c, (name, t) in zip(zip(*rows, strict=True), zip(_NAMES, _TYPES, strict=True), strict=True) if name in names])
                rows.clear()
                of.clear()
                return out

            def one(n: int, p: str, lang: str, source: str | bytes | None) -> Iterator[pa.RecordBatch]:
                try:
                    found = project_source(p, "" if source is None else source, lang)
                    mine = [(mode, i, *(getattr(item, c) for c in _COLUMNS), None) for mode, own in found.items() if mode in modes for i, item in enumerate(own)]
                except (ProjectionError, RecursionError) as e:
                    found, mine = {}, [(None,) * (len(_COLUMNS) + 2) + (str(e) or "too deeply nested",)]
                if marked and not mine and not any(found.values()):
                    mine = [(None,) * (len(_COLUMNS) + 3)]
                rows.extend(mine)
                of.extend([n] * len(mine))
                if len(rows) >= BATCH_ROWS:
                    yield made()

            def together(lang: str) -> Iterator[pa.RecordBatch]:
                numbers, paths, sources = (list(x) for x in zip(*waiting.pop(lang), strict=True))
                del letters[lang]
                rest, portions = repeated.by_columns(PROJECTORS[lang], lang, paths, sources, modes, names)
                for own, found in portions:
                    yield table(np.array(numbers)[own], found)
                for n in rest:
                    yield from one(numbers[n], paths[n], lang, sources[n])

            for start in range(0, batch.num_rows, _FILES):
                for n, (p, lang, source) in enumerate(zip(*(batch.column(c).slice(start, _FILES).to_pylist() for c in ("_path", "_language", "_content")), strict=True), start):
                    if not isinstance(source, str) or not repeated.may_be(lang, source):
                        yield from one(n, p, lang, source)
                        continue
                    waiting.setdefault(lang, []).append((n, p, source))
                    letters[lang] += len(source)
                    if letters[lang] >= _LETTERS:
                        yield from together(lang)
            for lang in list(waiting):
                yield from together(lang)
            if rows:
                yield made()

    names = [name for name in _NAMES if columns is None or name in columns or name == "error"]
    own_names = [*key, "_path", "_language"]
    chosen = files.where(F.col(language).isin(list(PROJECTORS))).select(*key, F.col(path).alias("_path"), F.col(language).alias("_language"), F.col(content).alias("_content"))
    schema = ", ".join([*(f"`{n}` {dict(chosen.dtypes)[n]}" for n in own_names), *(c for c in SCHEMA.split(", ") if c.split(" ")[0] in names)])
    found = (chosen if dealt else chosen.repartition(tasks, *(F.col(c) for c in key), "_path")).mapInArrow(run, schema)
    return found.withColumnRenamed("_path", "path").withColumnRenamed("_language", "language") if "path" not in key else found.drop("_path").withColumnRenamed("_language", "language")


def failures(rows: DataFrame, key: list[str]) -> DataFrame:
    """Files that did not parse, with the error. A comparison must have none."""
    return rows.where("error is not null").select(*key, "path", "error")


def canonical_files(rows: DataFrame, files: DataFrame, key: list[str], mode: str) -> DataFrame:
    """(key, path, canonical_text) of every file in one mode; empty where nothing is declared."""
    top = rows.where((F.col("mode") == mode) & F.col("parent_key").isNull() & F.col("error").isNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.rtrim("canonical_text", F.lit("\n")).alias("t")))), lambda x: x["t"])
    texts = top.groupBy(*key, "path").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("canonical_text"))
    by = list(dict.fromkeys([*key, "path"]))
    return files.select(*by).join(texts.select(*by, "canonical_text"), by, "left").select(*by, F.coalesce("canonical_text", F.lit("")).alias("canonical_text"))


def outline(rows: DataFrame, key: list[str], mode: str) -> DataFrame:
    """All items of the signatures mode, which holds every other, with ``retained``: whether ``mode`` has the key too."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    by = list(dict.fromkeys([*key, "path", "stable_key"]))
    kept = rows.where((F.col("mode") == mode) & F.col("error").isNull()).select(*by).distinct().withColumn("_kept", F.lit(True))
    return rows.where((F.col("mode") == "signatures") & F.col("error").isNull()).join(kept, by, "left").withColumn("retained", F.coalesce("_kept", F.lit(False))).drop("_kept", "mode", "error")


def show_json(rows: DataFrame, key: list[str], mode: str, revision: str | None = None) -> DataFrame:
    """One JSON object for each file: path, language, projection and outline. Lines count from 1, bytes from 0."""
    span = F.struct((F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), "start_byte", "end_byte")
    by = list(dict.fromkeys([*key, "path"]))
    marked = outline(rows, key, mode)
    own = rows.where((F.col("mode") == mode) & F.col("error").isNull())
    item = F.struct("ordinal", "stable_key", "parent_key", "kind", "name", span.alias("span"), "canonical_text")
    entry = F.struct("ordinal", "stable_key", "parent_key", "kind", "name", span.alias("span"), F.col("canonical_text").alias("signature"), F.col("retained").alias("retained_in_mode"))
    drop = lambda a: F.transform(F.array_sort(F.collect_list(a)), lambda x: x.dropFields("ordinal"))
    left = own.groupBy(*by).agg(drop(item).alias("items"))
    right = marked.groupBy(*by).agg(F.first("language").alias("language"), drop(entry).alias("outline"))
    return right.join(left, by, "left").select(*by, F.to_json(F.struct("path", "language", F.lit(mode).alias("mode"), F.lit(revision).cast("string").alias("revision"), "items", "outline")).alias("document"))


def suppress_equal(diffs: DataFrame) -> DataFrame:
    """Events whose projections differ; a move stays unless both are empty. Needs status, old_text, new_text."""
    old, new = F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))
    return diffs.where(F.when(F.col("status") == "moved", (old != "") | (new != "")).otherwise(old != new))


def project_diff(events: DataFrame, base: DataFrame, target: DataFrame, mode: str, rows: Sequence[DataFrame] | None = None) -> DataFrame:
    """Events with the canonical texts of both sides, equal ones left out. Sides are entries with text.

    Only files that events name are parsed. ``rows`` are the items of both
    sides' files where the caller has them, and has seen that none failed; here
    a file that fails makes the whole comparison fail.
    """

    def side(files: DataFrame, path: str, name: str, own: DataFrame | None) -> DataFrame:
        wanted = events.where(F.col(path).isNotNull()).select("repo", F.col(path).alias("path")).distinct()
        used = files.join(wanted, ["repo", "path"], "left_semi")
        found = checked(items(used, ["repo", "path"])) if own is None else own
        texts = canonical_files(found, used, ["repo", "path"], mode)
        return texts.select("repo", F.col("path").alias(path), F.col("canonical_text").alias(name))

    old, new = rows or (None, None)
    both = events.join(side(base, "old_path", "old_text", old), ["repo", "old_path"], "left").join(side(target, "path", "new_text", new), ["repo", "path"], "left")
    return suppress_equal(both.select("repo", "status", "old_path", "path", "language", "score", "old_text", "new_text"))


def checked(rows: DataFrame) -> DataFrame:
    """Item rows; one that carries an error fails the query."""
    message = F.concat_ws(": ", "path", "error")
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(message)).cast("string"))


def _sides(events: DataFrame, base: DataFrame, target: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Outlines of the files that events name, each with its event's status and both paths."""
    out = []
    for rows, path in ((base, "old_path"), (target, "path")):
        named = events.where(F.col(path).isNotNull()).select("repo", F.col(path).alias("at"), "status", F.col("old_path").alias("from_path"), F.col("path").alias("to_path"))
        marked = outline(rows, ["repo", "path"], mode).withColumnRenamed("path", "at")
        out.append(marked.join(named, ["repo", "at"]))
    return out[0], out[1]


def outline_diff(events: DataFrame, base: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """Both outlines of every event: repo, status, old_path, path, side (old or new), ordinal, the item, retained. Sides are item rows."""
    columns = ["ordinal", "stable_key", "parent_key", "kind", "name", "start_line", "end_line", "canonical_text", "retained"]
    old, new = (rows.select("repo", "status", F.col("from_path").alias("old_path"), F.col("to_path").alias("path"), F.lit(name).alias("side"), *columns) for rows, name in zip(_sides(events, base, target, mode), ("old", "new"), strict=True))
    return old.unionAll(new)


def declaration_diff(events: DataFrame, base: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """Declarations that the files of events gained, lost and changed: repo, path, stable_key, status, base_text, target_text."""
    from lithos.operators.comparison import declaration_changes

    old, new = (rows.select("repo", F.col("at").alias("path"), "stable_key", "parent_key", F.col("canonical_text").alias("text"), "retained") for rows in _sides(events, base, target, mode))
    return declaration_changes(old, new, events.where("status = 'moved'").select("repo", "old_path", "path"))
