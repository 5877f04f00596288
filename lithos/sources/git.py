"""Git repositories and plain directories as tables of entries.

Listings are metadata and come from one ``git`` call; contents are read by the
executors, a batch of blob ids to a call, so they never pass the driver. The
folder must be where every executor finds it.
"""

from __future__ import annotations

import os
import re
import stat
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lithos.functions.paths import LANGUAGES

ENTRIES = "path binary, language string, blob_id string, size long, executable boolean"
#: Ids of the tree without entries, in SHA-1 and SHA-256 repositories.
EMPTY_TREES = ("4b825dc642cb6eb9a060e54bf8d69288fbee4904", "6ef19b41225c5369f1c104d45d8d85efa9b057b53b14b4b9b939dd74decc5321")
SNAPSHOTS = (":empty", ":index", ":worktree")


class GitError(RuntimeError):
    """A git command that failed."""


def git(root: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], input=data, capture_output=True)
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def language_of(path: bytes) -> str | None:
    name = path.rsplit(b"/", 1)[-1]
    stem, dot, ending = name.rpartition(b".")
    return LANGUAGES.get(ending.decode("latin-1")) if dot and stem and ending else None


def discover(start: str) -> tuple[str, bool]:
    """The root above ``start`` and whether it is a repository; a plain directory is its own root."""
    try:
        return git(start, "rev-parse", "--show-toplevel").decode().rstrip("\n") or git(start, "rev-parse", "--absolute-git-dir").decode().rstrip("\n"), True
    except GitError as e:
        if "not a git repository" in str(e):
            return str(Path(start).resolve()), False
        if "work tree" in str(e):
            return git(start, "rev-parse", "--absolute-git-dir").decode().rstrip("\n"), True
        raise


def resolve_commit(root: str, spec: str) -> str:
    """The commit a branch, tag, id or suffix names; ranges are refused."""
    if not spec or ".." in spec or spec.startswith("-"):
        raise GitError(f"not a single revision: {spec}")
    return git(root, "rev-parse", "--verify", "--end-of-options", f"{spec}^{{commit}}").decode().strip()


def exists(root: str, spec: str, path: str) -> bool:
    """Whether a snapshot has anything at a path, of whatever kind and language."""
    if spec == ":empty" or spec in EMPTY_TREES:
        return False
    if spec in (":worktree", ":files"):
        return os.path.lexists(os.path.join(root, path))
    if spec == ":index":
        return bool(git(root, "--literal-pathspecs", "ls-files", "-z", "--", path))
    return bool(git(root, "--literal-pathspecs", "ls-tree", "-z", "--full-tree", resolve_commit(root, spec), "--", path))


def merge_base(root: str, a: str, b: str) -> str:
    return git(root, "merge-base", resolve_commit(root, a), resolve_commit(root, b)).decode().split("\n")[0]


def first_parent_steps(root: str, base: str, target: str) -> list[tuple[str, str, str]]:
    """(parent, commit, subject) from ``target`` down to ``base``, newest first; an error if ``base`` is no first-parent ancestor."""
    low, high = resolve_commit(root, base), resolve_commit(root, target)
    out = []
    if low == high:
        return out
    for line in git(root, "log", "--first-parent", "--format=%H%x00%P%x00%s", high).decode(errors="replace").splitlines():
        commit, parents, subject = line.split("\0")
        parent = parents.split(" ")[0]
        if not parent:
            break
        out.append((parent, commit, subject))
        if parent == low:
            return out
    raise GitError(f"{base} is not a first-parent ancestor of {target}")


def _regular(root: str, path: bytes) -> os.stat_result | None:
    """The file's state, if it is a regular file whose real place is below the root."""
    full = os.path.join(os.fsencode(root), path)
    try:
        found = os.lstat(full)
    except OSError:
        return None
    inside = os.path.realpath(full).startswith(os.path.realpath(os.fsencode(root)).rstrip(b"/") + b"/")
    return found if stat.S_ISREG(found.st_mode) and inside else None


def blob_id(data: bytes, algorithm: str) -> str:
    import hashlib

    return hashlib.new(algorithm, b"blob %d\0" % len(data) + data).hexdigest()


def _hash_file(root: str, path: bytes, size: int, algorithm: str) -> str:
    """The blob id of a file's bytes, read in pieces; an error if its size changes meanwhile."""
    import hashlib

    h, read = hashlib.new(algorithm), 0
    h.update(b"blob %d\0" % size)
    with open(os.path.join(os.fsencode(root), path), "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
            read += len(part)
    if read != size:
        raise GitError(f"{os.fsdecode(path)} changed while it was read")
    return h.hexdigest()


Entry = tuple[bytes, str, str | None, int | None, bool]


def listing(root: str, spec: str, hashed: bool = True) -> list[Entry]:
    """Entries of a snapshot: regular files of known languages, by raw path. Specs are a revision, :index, :worktree, :empty, or :files for a directory without Git.

    Files on disk have no id unless ``hashed``: reading them is work for the executors.
    """
    out: dict[bytes, Entry] = {}
    if spec == ":empty" or spec in EMPTY_TREES:
        return []
    if spec in (":worktree", ":files"):
        if spec == ":worktree":
            paths = set(git(root, "ls-files", "-z").split(b"\0")) | set(git(root, "ls-files", "-o", "--exclude-standard", "-z").split(b"\0"))
        else:
            paths = _walk(root)
        algorithm = algorithm_of(root, spec)
        for p in paths - {b""}:
            if (lang := language_of(p)) and (state := _regular(root, p)):
                out[p] = (p, lang, _hash_file(root, p, state.st_size, algorithm) if hashed else None, state.st_size, bool(state.st_mode & 0o111))
    elif spec == ":index":
        ids = []
        for line in git(root, "ls-files", "-s", "-z").split(b"\0"):
            if line:
                head, p = line.split(b"\t", 1)
                mode, blob, stage = head.decode().split(" ")
                if stage == "0" and mode in ("100644", "100755") and (lang := language_of(p)):
                    ids.append(blob)
                    out[p] = (p, lang, blob, None, mode == "100755")
        sizes = git(root, "cat-file", "--batch-check=%(objectsize)", data="\n".join(ids).encode()).decode().split()
        out = {p: (*e[:3], int(n), e[4]) for (p, e), n in zip(out.items(), sizes, strict=True)}
    else:
        for line in git(root, "ls-tree", "-r", "-z", "--long", "--full-tree", resolve_commit(root, spec)).split(b"\0"):
            if line:
                head, p = line.split(b"\t", 1)
                mode, kind, blob, size = head.decode().split()
                if kind == "blob" and mode in ("100644", "100755") and (lang := language_of(p)):
                    out[p] = (p, lang, blob, int(size), mode == "100755")
    return [out[p] for p in sorted(out)]


def algorithm_of(root: str, spec: str) -> str:
    """The hash of blob ids."""
    return "sha1" if spec == ":files" else git(root, "rev-parse", "--show-object-format").decode().strip()


class Ignored:
    """Rules of ignore files: ``!`` takes back, a slash anchors, a last slash means folders, ``*`` stops at slashes and ``**`` does not; later rules win."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []  # folder of the file, pattern, folders only, ignored

    def add(self, folder: str, text: str) -> None:
        for line in text.splitlines():
            rule = line.rstrip() if not line.endswith("\\ ") else line
            if not rule or rule.startswith("#"):
                continue
            ignored = not rule.startswith("!")
            rule = rule[0 if ignored else 1 :].removeprefix("\\") if rule[:2] in ("\\!", "\\#") or not ignored else rule
            only = rule.endswith("/")
            rule = rule.rstrip("/")
            anchored = "/" in rule
            self.rules.append((folder, re.compile(("" if anchored else "(?:.*/)?") + _glob(rule.lstrip("/"))), only, ignored))

    def has(self, path: str, is_folder: bool) -> bool:
        """Whether a path below the root is ignored by its own name; its folders are asked before."""
        for folder, pattern, only, ignored in reversed(self.rules):
            inside = path[len(folder) + 1 :] if folder and path.startswith(folder + "/") else path if not folder else None
            if inside is not None and (is_folder or not only) and pattern.fullmatch(inside):
                return ignored
        return False


def _glob(rule: str) -> str:
    """The regular expression of one ignore rule."""
    out, i = [], 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif rule.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            inner = rule[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            i += c == "\\" and i + 1 < len(rule)
            out.append(re.escape(rule[i]))
            i += 1
    return "".join(out)


def _walk(root: str) -> set[bytes]:
    """Files below a directory; ``.git``, links, and what ``.gitignore`` files name are left out."""
    found: set[bytes] = set()
    ignored = Ignored()
    for folder, folders, files in os.walk(root):
        here = os.path.relpath(folder, root)
        here = "" if here == "." else here
        if ".gitignore" in files:
            ignored.add(here, Path(folder, ".gitignore").read_text(errors="replace"))
        at = lambda name, here=here: f"{here}/{name}" if here else name
        folders[:] = sorted(d for d in folders if d != ".git" and not ignored.has(at(d), True))
        found.update(os.fsencode(at(f)) for f in files if not ignored.has(at(f), False))
    return found


class _Part(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


def _read(root: str, on_disk: bool, rows: list[Entry]) -> list[bytes]:
    """Contents of entries, each blob id read once. A file on disk whose size is no longer the stated one is an error."""
    if on_disk:
        out = [Path(os.fsdecode(os.path.join(os.fsencode(root), r[0]))).read_bytes() for r in rows]
        for r, c in zip(rows, out, strict=True):
            if len(c) != r[3]:
                raise GitError(f"{os.fsdecode(r[0])} changed while it was read")
        return out
    ids = list(dict.fromkeys(r[2] for r in rows))
    raw, known, at = git(root, "cat-file", "--batch", data="\n".join(ids).encode()), {}, 0
    for blob in ids:
        end = raw.index(b"\n", at)
        head = raw[at:end].split(b" ")
        if len(head) < 3:
            raise GitError(f"no object {blob}")
        size = int(head[2])
        known[blob] = raw[end + 1 : end + 1 + size]
        at = end + 2 + size
    return [known[r[2]] for r in rows]


class _BlobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.spec, self.batch = options["path"], options["spec"], int(options.get("batch", "256"))

    def partitions(self) -> list[InputPartition]:
        rows = listing(self.root, self.spec, hashed=False)
        return [_Part(rows[i : i + self.batch]) for i in range(0, len(rows), self.batch)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows = partition.rows
        if not rows:
            return
        on_disk = self.spec in (":worktree", ":files")
        contents = _read(self.root, on_disk, rows)
        if on_disk:
            algorithm = algorithm_of(self.root, self.spec)
            rows = [(*r[:2], blob_id(c, algorithm), *r[3:]) for r, c in zip(rows, contents, strict=True)]
        columns = list(zip(*rows, strict=True))
        kinds = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(contents, pa.binary())], names=["path", "language", "blob_id", "size", "executable", "content"])


class GitTree(DataSource):
    """``spark.read.format("git_tree").option("spec", revision).load(folder)``: entries with their content."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return ENTRIES + ", content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BlobReader(self.options)


#: Files that one task hashes, or blobs that one task reads.
BATCH = 256


def _dealt(spark: SparkSession, rows: list[Entry], schema: str) -> DataFrame:
    """Rows in partitions of ``BATCH``."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, -(-len(rows) // BATCH)))


#: In front of the path, what stands for the id of a file that was not read.
UNREAD = "unread:"
ON_DISK = (":worktree", ":files")


def _hashed(rows: DataFrame, root: str, spec: str) -> DataFrame:
    """Entries on disk with the ids of those whose ``_read`` is true, each read once by an executor; others get a stand-in that equals no id."""
    algorithm = algorithm_of(root, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*(batch.column(c).to_pylist() for c in ("path", "size", "_read")), strict=True)
            ids = [_hash_file(root, p, n, algorithm) if read else UNREAD + p.hex() for p, n, read in told]
            yield batch.select(names).set_column(2, "blob_id", pa.array(ids, pa.string()))

    names = [c.split(" ")[0] for c in ENTRIES.split(", ")]
    return rows.select(*names, "_read").mapInArrow(run, ENTRIES)


def entries(spark: SparkSession, root: str, spec: str, partners: DataFrame | None = None) -> DataFrame:
    """A snapshot's entries without contents; files on disk are hashed by the executors.

    With ``partners``, the other side's entries, only files on disk are read whose
    language and size one of them has: any other file equals none of them, and
    its id begins with ``UNREAD``.
    """
    rows = listing(root, spec, hashed=False)
    if spec not in ON_DISK:
        return spark.createDataFrame(rows, ENTRIES)
    dealt = _dealt(spark, rows, ENTRIES)
    if partners is None:
        return _hashed(dealt.withColumn("_read", F.lit(True)), root, spec)
    alike = partners.select("language", "size").distinct().withColumn("_read", F.lit(True))
    return _hashed(dealt.join(alike, ["language", "size"], "left").withColumn("_read", F.coalesce("_read", F.lit(False))), root, spec)


def listed(spark: SparkSession, root: str, spec: str) -> DataFrame:
    """A snapshot's entries by their listing alone; files on disk have no id."""
    return spark.createDataFrame(listing(root, spec, hashed=False), ENTRIES)


def single(spark: SparkSession, root: str, path: str) -> DataFrame | None:
    """The entry of one file on disk, whatever its repository says of it; None unless it is regular, reached by no link, and of a known language."""
    raw = os.fsencode(path)
    lang, state = language_of(raw), _regular(root, raw)
    if lang is None or state is None:
        return None
    row = spark.createDataFrame([(raw, lang, None, state.st_size, bool(state.st_mode & 0o111))], ENTRIES)
    return _hashed(row.withColumn("_read", F.lit(True)), root, ":worktree" if discover(root)[1] else ":files")


def identified(rows: DataFrame, root: str, spec: str) -> DataFrame:
    """Entries whose files were not read, with their ids; all others as they are."""
    if spec not in ON_DISK:
        return rows
    names = [c.split(" ")[0] for c in ENTRIES.split(", ")]
    unread = F.startswith("blob_id", F.lit(UNREAD))
    return rows.where(~unread).select(*names).unionAll(_hashed(rows.where(unread).withColumn("_read", F.lit(True)), root, spec))


def contents_of(wanted: DataFrame, root: str, spec: str) -> DataFrame:
    """``wanted`` entries with their content, read by the executors in batches; a blob that several of a batch share is read once."""
    on_disk = spec in ON_DISK
    names = [c.split(" ")[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                data = _read(root, on_disk, list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*names, "content"])

    return wanted.select(*names).mapInArrow(run, ENTRIES + ", content binary")


def contents(spark: SparkSession, root: str, spec: str) -> DataFrame:
    """A snapshot's entries with contents, read by the executors."""
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").option("spec", spec).load(root)


def commits(spark: SparkSession, root: str, target: str) -> DataFrame:
    """(commit_id, parent_id, subject, position) along the first parents of ``target``."""
    lines = git(root, "log", "--first-parent", "--format=%H%x00%P%x00%s", resolve_commit(root, target)).decode(errors="replace").splitlines()
    rows = [(c, p.split(" ")[0] or None, s, i) for i, (c, p, s) in enumerate(line.split("\0") for line in lines)]
    return spark.createDataFrame(rows, "commit_id string, parent_id string, subject string, position int")


DELTAS = "step long, path binary, language string, status string, old_blob string, new_blob string, old_size long, new_size long"


def _step_deltas(root: str, parent: str, commit: str) -> list[tuple[bytes, str, str | None, str | None]]:
    """(path, language, old and new blob id) of regular files of known languages that two commits have differently."""
    fields = git(root, "diff-tree", "-r", "-z", "--no-renames", "--full-index", "--no-abbrev", parent, commit).split(b"\0")
    out = []
    for head, path in zip(fields[0::2], fields[1::2], strict=False):
        was, now, old, new, _ = head.decode().lstrip(":").split(" ")
        a, b = old if was in ("100644", "100755") else None, new if now in ("100644", "100755") else None
        if a != b and (lang := language_of(path)):
            out.append((path, lang, a, b))
    return out


def step_deltas(spark: SparkSession, root: str, steps: list[tuple[int, str, str]]) -> DataFrame:
    """What each step (number, parent, commit) changes, by the executors, a batch of steps to a task: rows follow changes, not trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *d) for n, p, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for d in _step_deltas(root, p, c)]
            ids = list(dict.fromkeys(b for r in rows for b in r[3:] if b))
            sizes = dict(zip(ids, map(int, git(root, "cat-file", "--batch-check=%(objectsize)", data="\n".join(ids).encode()).split()), strict=True)) if ids else {}
            status = ["new_only" if a is None else "old_only" if b is None else "modified" for *_, a, b in rows]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            made = [*columns[:3], status, *columns[3:], [sizes.get(a) for a in columns[3]], [sizes.get(b) for b in columns[4]]]
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=[c.split(" ")[0] for c in DELTAS.split(", ")])

    given = spark.createDataFrame(steps, "step long, parent string, commit string")
    return given.repartition(max(1, -(-len(steps) // 16))).mapInArrow(run, DELTAS)


def blobs(wanted: DataFrame, root: str) -> DataFrame:
    """Rows of distinct ``wanted`` (blob_id) with their content, read by the executors."""
    rows = wanted.select(F.lit(b"").alias("path"), F.lit("").alias("language"), "blob_id", F.lit(0).cast("long").alias("size"), F.lit(False).alias("executable"))
    return wanted.join(contents_of(rows, root, "").select("blob_id", "content"), "blob_id")
