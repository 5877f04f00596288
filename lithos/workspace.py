"""The public entry point: one repository or folder, shown or compared as DataFrames."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.paths import display_path, in_scope
from lithos.lang.items import MODES, Item, ProjectionError
from lithos.operators import comparison, documents, folds, history, lines, projection
from lithos.operators.store import ProjectionStore
from lithos.plans.lineage import cut, new_path
from lithos.sources import git

#: Largest file of areas that is read.
CONFIG_BYTES = 1 << 20


class EngineError(RuntimeError):
    """A question that the sources cannot answer: bad scope, failed parse, Git error."""


class UsageError(ValueError):
    """Options that do not go together."""


def load_areas(path: str | Path) -> dict[str, list[str]]:
    """Area names and their paths from a TOML file with the one table ``[areas]``."""
    file = Path(path)
    if file.is_symlink() or file.stat().st_size > CONFIG_BYTES:
        raise EngineError(f"{file} is a link or too large")
    try:
        found = tomllib.loads(file.read_text())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise EngineError(f"{file}: {e}") from e
    if set(found) - {"areas"}:
        raise EngineError(f"unknown keys: {', '.join(sorted(set(found) - {'areas'}))}")
    out = {}
    for name, given in found.get("areas", {}).items():
        listed = [given] if isinstance(given, str) else given
        if not isinstance(listed, list) or not listed or not all(isinstance(p, str) for p in listed):
            raise EngineError(f"area {name}: expected paths")
        out[name] = sorted({normalize(p) for p in listed})
    return out


def normalize(path: str) -> str:
    """A relative path without empty components and dots; one that climbs is refused."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in parts:
        raise EngineError(f"path leaves the root: {path}")
    return "/".join(parts)


class Workspace:
    """``folder`` is a Git repository, any folder in one, or a plain directory that all executors see.

    Paths are relative to ``cwd``, the root unless given, or absolute below the root.
    ``store`` is the folder of a ``ProjectionStore`` that outlives the workspace;
    else the workspace has one of its own. Every content is parsed once in a store.
    """

    def __init__(self, spark: SparkSession, folder: str, cwd: str | None = None, store: str | None = None):
        self.spark = spark
        self.root, self.is_git = git.discover(folder)
        self.cwd = cwd or self.root
        self.store = ProjectionStore(spark, store or new_path(spark, "projections"))

    # -- scope -----------------------------------------------------------------

    def select(self, path: str) -> str:
        """A path below the root, by its text alone; '' is the root. One that leads out of it is refused."""
        parts = [] if path.startswith("/") else [p for p in self.cwd.split("/") if p]
        for p in path.split("/"):
            if p == "..":
                if not parts:
                    raise EngineError(f"path leaves the root: {path}")
                parts.pop()
            elif p not in ("", "."):
                parts.append(p)
        root = [p for p in self.root.split("/") if p]
        if parts[: len(root)] != root:
            raise EngineError(f"path leaves the root: {path}")
        return "/".join(parts[len(root) :])

    def scope(self, paths: tuple[str, ...] = (), areas: tuple[str, ...] = (), config: str | None = None) -> list[list[str]]:
        """Groups of prefixes: one for each path, one for each area. Paths and areas exclude each other."""
        if paths and areas:
            raise UsageError("paths and areas exclude each other")
        if areas:
            known = load_areas(config or Path(self.root, "areas.toml"))
            missing = [a for a in areas if a not in known]
            if missing:
                raise EngineError(f"unknown areas: {', '.join(missing)}")
            return [known[a] for a in dict.fromkeys(areas)]
        groups = [[self.select(p)] for p in dict.fromkeys(paths)]
        return [] if [""] in groups else groups

    def _check_scope(self, groups: list[list[str]], *specs: str) -> None:
        """Every group must hold something on one of the sides, of whatever kind."""
        for group in groups:
            if not any(git.exists(self.root, spec, p) for spec in specs for p in group):
                raise EngineError(f"nothing at {', '.join(group)} in {' or '.join(specs)}")

    def _entries(self, spec: str, other: str | None = None) -> DataFrame:
        """Entries without contents: repo, path as displayed and raw, language, blob_id, size. Of files on disk, where another side is named, only those with a partner there are read."""
        partners = git.listed(self.spark, self.root, other) if other and spec in git.ON_DISK else None
        return self._shown(git.entries(self.spark, self.root, spec, partners))

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("path", "raw_path").select(F.lit(self.root).alias("repo"), display_path("raw_path").alias("path"), "raw_path", "language", "blob_id", "size", "executable")

    def _read(self, wanted: DataFrame, spec: str) -> DataFrame:
        """Entries with content, and text where that is UTF-8."""
        rows = git.contents_of(wanted.withColumn("path", F.col("raw_path")), self.root, spec).withColumnRenamed("path", "raw_path")
        shown = rows.select(F.lit(self.root).alias("repo"), display_path("raw_path").alias("path"), "raw_path", "language", "blob_id", "size", "content")
        return shown.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))

    @staticmethod
    def _scoped(files: DataFrame, groups: list[list[str]]) -> DataFrame:
        return files.where(in_scope(F.col("path"), [p for g in groups for p in g]))

    @staticmethod
    def _mode(mode: str) -> None:
        if mode not in MODES:
            raise UsageError(f"mode must be one of {', '.join(MODES)}")

    @staticmethod
    def _no_failures(*sides: DataFrame) -> None:
        """An error for the first file, by path, that does not parse or is not UTF-8."""
        bad = sorted(tuple(r) for rows in sides for r in projection.failures(rows, []).orderBy("path").limit(1).collect())
        if bad:
            raise EngineError(f"{bad[0][0]}: {bad[0][1]}")

    # -- show ------------------------------------------------------------------

    def show(self, mode: str, revision: str | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """(repo, path, canonical_text) of every file in scope. Without a revision, of the files on disk."""
        rows, files = self._items(mode, revision, paths, areas)
        return projection.canonical_files(rows, files, ["repo", "path"], mode)

    def show_text(self, mode: str, revision: str | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> str:
        found = lines.show_document(self.show(mode, revision, paths, areas), ["repo"]).collect()
        return found[0].document if found else ""

    def show_json(self, mode: str, revision: str | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """One JSON object for each file; ``show_document`` has the whole snapshot's."""
        rows, _ = self._items(mode, revision, paths, areas)
        return projection.show_json(rows, ["repo", "path"], mode, revision)

    def show_document(self, mode: str, revision: str | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """(repo, document): the JSON document of a snapshot, with every file's projection text, items and outline."""
        rows, files = self._items(mode, revision, paths, areas)
        return documents.show_document(rows, files, mode, revision and self.snapshot_id(revision))

    def show_file(self, mode: str, path: str) -> DataFrame:
        """(repo, path, canonical_text) of one regular file on disk, tracked or not; links and files without a language are refused."""
        self._mode(mode)
        place = self.select(path)
        found = git.single(self.spark, self.root, place)
        if found is None:
            raise EngineError(f"{path} is no regular file of a known language below the root")
        spec = ":worktree" if self.is_git else ":files"
        files = cut(self._shown(found))
        self.store.fill(files, lambda wanted: self._read(wanted, spec))
        rows = cut(self.store.items(files, ["repo", "path"]))
        self._no_failures(rows)
        return projection.canonical_files(rows, files, ["repo", "path"], mode)

    def outline(self, mode: str, revision: str | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        rows, _ = self._items(mode, revision, paths, areas)
        return projection.outline(rows, ["repo", "path"], mode)

    def folds(self, mode: str, revision: str | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        rows, files = self._items(mode, revision, paths, areas, texts=True)
        return folds.fold_regions(projection.outline(rows, ["repo", "path"], mode), files, ["repo", "path"])

    def visible(self, mode: str, revision: str | None = None, overrides: dict[str, bool] | None = None, paths: tuple[str, ...] = (), areas: tuple[str, ...] = (), recursive: dict[str, bool] | None = None) -> DataFrame:
        """The rows of the folded view of every file in scope, folds with closed_text and suffix.

        ``overrides`` open or close regions by key, ``recursive`` them and all below
        them, where the nearest one decides.
        """
        rows, files = self._items(mode, revision, paths, areas, texts=True)
        key = ["repo", "path"]
        found = cut(folds.fold_regions(projection.outline(rows, key, mode), files, key))
        if recursive:
            found = folds.opened(found, key, self.spark.createDataFrame(list(recursive.items()), "stable_key string, is_open boolean"))
        shown = folds.visible(found, files, key, mode, overrides)
        return shown.join(folds.closed_texts(found, rows, key, mode), [*key, "stable_key"], "left")

    def snapshot_id(self, spec: str) -> str:
        """The commit's id, or the name of a snapshot that is none."""
        return spec if spec.startswith(":") or spec in git.EMPTY_TREES else git.resolve_commit(self.root, spec)

    def _items(self, mode, revision, paths, areas, texts: bool = False) -> tuple[DataFrame, DataFrame]:
        """Items of every file in scope, and the files, with their text if asked for. Contents that the store knows are not read for their items."""
        self._mode(mode)
        spec = revision or (":worktree" if self.is_git else ":files")
        groups = self.scope(paths, areas)
        self._check_scope(groups, spec)
        files = cut(self._scoped(self._entries(spec), groups))
        self.store.fill(files, lambda wanted: self._read(wanted, spec))
        rows = cut(self.store.items(files, ["repo", "path"]))
        self._no_failures(rows)
        return rows, cut(self._read(files, spec)) if texts else files

    # -- diff ------------------------------------------------------------------

    def _compared(self, base: str, target: str, mode: str, merge_base: bool, paths, areas) -> tuple[DataFrame, DataFrame, DataFrame, str, str]:
        """Events in scope with both canonical texts, and the items of the files they name on either side."""
        self._mode(mode)
        if merge_base:
            if any(s.startswith(":") or s in git.EMPTY_TREES for s in (base, target)):
                raise UsageError("a merge base needs two commits")
            base = git.merge_base(self.root, base, target)
        groups = self.scope(paths, areas)
        self._check_scope(groups, base, target)
        # ids and sizes decide what is read
        old, new = cut(self._entries(base, target)), cut(self._entries(target, base))
        lazy = [comparison.Lazy(side, lambda wanted, spec=spec: self._read(wanted, spec)) for side, spec in ((old, base), (new, target))]
        events = cut(comparison.comparison_plan(*lazy))
        if groups:
            events = comparison.scoped(events, lambda c: in_scope(c, [p for g in groups for p in g]))
        named = lambda side, c: side.join(events.where(F.col(c).isNotNull()).select("repo", F.col(c).alias("path")).distinct(), ["repo", "path"], "left_semi")
        files, rows = [], []
        for side, c, spec in ((old, "old_path", base), (new, "path", target)):
            # a store knows contents by their ids, so what is named now and was not read has its id now
            files.append(cut(self._shown(git.identified(named(side, c).withColumn("path", F.col("raw_path")).drop("raw_path"), self.root, spec))))
            self.store.fill(files[-1], lambda wanted, spec=spec: self._read(wanted, spec))
            rows.append(cut(self.store.items(files[-1], ["repo", "path"])))
        self._no_failures(*rows)
        return cut(projection.project_diff(events, *files, mode, rows)), *rows, base, target

    def diff(self, base: str, target: str, mode: str, merge_base: bool = False, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """Events of two snapshots whose projections differ, with both canonical texts. Pairs are found before the scope applies.

        A file that an event in scope names and that does not parse is an error; unchanged files are not read.
        """
        return self._compared(base, target, mode, merge_base, paths, areas)[0]

    def diff_text(self, base: str, target: str, mode: str, **options) -> str:
        events = self.diff(base, target, mode, **options).withColumn("id", F.coalesce("path", "old_path"))
        found = lines.diff_document(events, ["id"]).orderBy("id").collect()
        return "\n".join(r.document for r in found)

    def diff_document(self, base: str, target: str, mode: str, merge_base: bool = False, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """(repo, document): the JSON document of the differences."""
        events, old, new, low, high = self._compared(base, target, mode, merge_base, paths, areas)
        return documents.diff_document(events, old, new, mode, self.snapshot_id(low), self.snapshot_id(high))

    def diff_outlines(self, base: str, target: str, mode: str, merge_base: bool = False, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """The outlines of both sides of every file whose projection differs: side, status, old_path, path and the items with ``retained``."""
        events, old, new, _, _ = self._compared(base, target, mode, merge_base, paths, areas)
        return projection.outline_diff(events, old, new, mode)

    def declarations(self, base: str, target: str, mode: str, merge_base: bool = False, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """Declarations added, deleted and changed in files whose projection differs, keys of moved files rebased."""
        events, old, new, _, _ = self._compared(base, target, mode, merge_base, paths, areas)
        return projection.declaration_diff(events, old, new, mode)

    def history(self, base: str, target: str) -> list[tuple[str, str, str]]:
        """(parent, commit, subject) of every first-parent step, newest first."""
        if any(s.startswith(":") for s in (base, target)):
            raise UsageError("history needs two commits")
        return git.first_parent_steps(self.root, base, target)

    def history_events(self, base: str, target: str) -> DataFrame:
        """Events of every first-parent step from ``base`` to ``target``, in one plan: step (1 is the oldest), parent, commit, subject, status, old_path, path, language, score."""
        deltas, names = self._deltas(base, target)
        return names.join(history.step_events(deltas, self._blob_texts).drop("repo"), "step")

    def _deltas(self, base: str, target: str) -> tuple[DataFrame, DataFrame]:
        """What each step changes, paths as displayed, and the steps' names."""
        steps = [(n, *s) for n, s in enumerate(reversed(self.history(base, target)), 1)]
        names = self.spark.createDataFrame(steps, "step long, parent string, commit string, subject string")
        found = git.step_deltas(self.spark, self.root, [s[:3] for s in steps]).withColumn("path", display_path("path"))
        return cut(found.withColumn("repo", F.lit(self.root))), names

    def _blob_texts(self, wanted: DataFrame) -> DataFrame:
        text = F.col("content").cast("string")
        return git.blobs(wanted, self.root).select("blob_id", F.when(F.is_valid_utf8(text), text).alias("text"))

    def history_diff(self, base: str, target: str, mode: str, paths: tuple[str, ...] = (), areas: tuple[str, ...] = ()) -> DataFrame:
        """``diff`` of every first-parent step in one plan: ``history_events`` in scope whose projections differ, with old_text and new_text.

        Contents are parsed once for all steps. A file that an event in scope
        names and that does not parse is an error.
        """
        self._mode(mode)
        groups = self.scope(paths, areas)
        self._check_scope(groups, base, target)
        deltas, names = self._deltas(base, target)
        events = cut(history.step_events(deltas, self._blob_texts))
        if groups:
            events = comparison.scoped(events, lambda c: in_scope(c, [p for g in groups for p in g]))
        step = F.col("step").cast("string").alias("repo")  # a step is a repo of its own
        events = cut(events.withColumn("repo", step))
        files = []
        for path, blob in (("old_path", "old_blob"), ("path", "new_blob")):
            own = deltas.where(F.col(blob).isNotNull()).select(step, "path", "language", F.col(blob).alias("blob_id"))
            files.append(cut(own.join(events.where(F.col(path).isNotNull()).select("repo", F.col(path).alias("path")).distinct(), ["repo", "path"], "left_semi")))
        both = files[0].unionAll(files[1])
        self.store.fill(both, lambda wanted: git.blobs(wanted.select("blob_id", "language"), self.root))
        rows = [cut(self.store.items(f, ["repo", "path"])) for f in files]
        self._no_failures(*rows)
        found = projection.project_diff(events, *files, mode, rows)
        return names.join(found.withColumn("step", F.col("repo").cast("long")).drop("repo"), "step")

    def history_diffs(self, base: str, target: str, mode: str, **options) -> Iterator[tuple[str, str, str, DataFrame]]:
        """(parent, commit, subject, events) of every step, newest first, out of one ``history_diff``."""
        steps = self.history(base, target)
        if steps:
            found = cut(self.history_diff(base, target, mode, **options))
            for parent, commit, subject in steps:
                yield parent, commit, subject, found.where(F.col("commit") == commit).drop("step", "parent", "commit", "subject")


def project_source(path: str, data: bytes | str, mode: str) -> list[Item]:
    """Items of one source, its language by extension."""
    language = git.language_of(path.encode())
    if language is None:
        raise UsageError(f"no language for {path}")
    if mode not in MODES:
        raise UsageError(f"mode must be one of {', '.join(MODES)}")
    return projection.project_source(path, data, language, mode)


__all__ = ["EngineError", "Item", "ProjectionError", "UsageError", "Workspace", "load_areas", "normalize", "project_source"]
