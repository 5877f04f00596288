"""Git sources and the workspace on repositories made here."""

import os
import subprocess

import pytest

from lithos.sources import git
from lithos.workspace import EngineError, UsageError, Workspace, load_areas, project_source


def run(root, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b.c", "HOME": str(root)}
    subprocess.run(["git", "-c", "init.defaultBranch=main", "-C", str(root), *args], check=True, capture_output=True, env=env)


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-q")
    put(root, "src/keep.py", "def keep(a: int) -> int:\n    return a\n")
    put(root, "src/gone.py", "class Gone: ...\n")
    put(root, "src/move.py", "def moved(x): ...\n\n\ndef more(): ...\n")
    put(root, "src/body.py", "def body():\n    return 1\n")
    put(root, "lib.rs", "pub fn f() {}\n")
    put(root, "notes.txt", "no source")
    os.symlink("lib.rs", root / "link.rs")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "one")
    run(root, "tag", "one")
    (root / "src/gone.py").unlink()
    run(root, "mv", "src/move.py", "src/new.py")
    put(root, "src/body.py", "def body():\n    return 2\n")
    put(root, "src/keep.py", "def keep(a: int, b: str) -> int:\n    return a\n")
    put(root, "src/add.py", "VALUE: int = 3\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "two\n\nbody")
    put(root, "src/loose.py", "def loose(): ...\n")
    put(root, ".gitignore", "ignored.py\n")
    put(root, "ignored.py", "x = 1\n")
    return root


def test_listings(repo):
    root, is_git = git.discover(str(repo / "src"))
    assert is_git and root == str(repo)
    assert [e[0] for e in git.listing(root, "one")] == [b"lib.rs", b"src/body.py", b"src/gone.py", b"src/keep.py", b"src/move.py"]
    assert [e[0] for e in git.listing(root, ":index")] == [e[0] for e in git.listing(root, "HEAD")]
    assert {e[0] for e in git.listing(root, ":worktree")} - {e[0] for e in git.listing(root, "HEAD")} == {b"src/loose.py"}
    assert git.listing(root, ":empty") == [] == git.listing(root, git.EMPTY_TREES[0])
    same = {e[0]: e[2:4] for e in git.listing(root, "HEAD")}
    assert all(e[2:4] == same[e[0]] for e in git.listing(root, ":worktree") if e[0] in same)
    for bad in ("one..HEAD", "nothing", "-x", ""):
        with pytest.raises(git.GitError):
            git.resolve_commit(root, bad)


def test_history_and_merge_base(repo):
    root = str(repo)
    w = git.first_parent_steps(root, "one", "HEAD")
    assert [s for _, _, s in w] == ["two"] and git.first_parent_steps(root, "one", "one") == []
    assert git.merge_base(root, "one", "HEAD") == git.resolve_commit(root, "one")
    with pytest.raises(git.GitError):
        git.first_parent_steps(root, "HEAD", "one")


def test_show(spark, repo):
    w = Workspace(spark, str(repo))
    found = {r.path: r.canonical_text for r in w.show("signatures", "HEAD").collect()}
    assert found["src/keep.py"] == "def keep(a: int, b: str) -> int: ...\n" and found["lib.rs"] == "pub fn f();\n" and set(found) == {"lib.rs", "src/add.py", "src/body.py", "src/keep.py", "src/new.py"}
    assert w.show_text("types", "HEAD", paths=("lib.rs",)) == "== lib.rs ==\n"
    assert "loose" in w.show_text("signatures")
    assert {r.path for r in w.show("signatures", "HEAD", paths=("src/",)).collect()} == {p for p in found if p.startswith("src/")}
    with pytest.raises(EngineError):
        w.show("signatures", "HEAD", paths=("other",))
    with pytest.raises(EngineError):
        w.show("signatures", "HEAD", paths=("../x",))
    with pytest.raises(UsageError):
        w.show("all")
    with pytest.raises(UsageError):
        w.scope(("a",), ("b",))


def test_diff(spark, repo):
    w = Workspace(spark, str(repo))
    found = {(r.status, r.old_path, r.path) for r in w.diff("one", "HEAD", "signatures").collect()}
    assert found == {("deleted", "src/gone.py", None), ("moved", "src/move.py", "src/new.py"), ("modified", "src/keep.py", "src/keep.py"), ("added", None, "src/add.py")}
    assert {r.status for r in w.diff("one", "HEAD", "types").collect()} == {"deleted"}
    text = w.diff_text("one", "HEAD", "signatures", paths=("src/keep.py",))
    assert text == "diff a/src/keep.py b/src/keep.py\n--- a/src/keep.py\n+++ b/src/keep.py\n@@ -1 +1 @@\n-def keep(a: int) -> int: ...\n+def keep(a: int, b: str) -> int: ...\n"
    # the scope comes after the pairs: one end of the move is enough
    assert [(r.status, r.old_path) for r in w.diff("one", "HEAD", "signatures", paths=("src/new.py",)).collect()] == [("moved", "src/move.py")]
    assert {r.status for r in w.diff(":empty", "one", "signatures").collect()} == {"added"}
    assert {r.path for r in w.diff("HEAD", ":worktree", "signatures").collect()} == {"src/loose.py"}
    with pytest.raises(UsageError):
        w.diff(":empty", "HEAD", "types", merge_base=True)


def test_outline_json_and_folds(spark, repo):
    import json

    w = Workspace(spark, str(repo))
    assert {r.stable_key: r.retained for r in w.outline("types", "one").collect()}["src/keep.py::fn::keep"] is False
    doc = json.loads({r.path: r.document for r in w.show_json("signatures", "HEAD").collect()}["src/keep.py"])
    assert doc["items"][0]["span"]["start_line"] == 1 and doc["outline"][0]["retained_in_mode"] is True and doc["language"] == "python"
    assert {(r.stable_key, r.start_line, r.end_line, r.level) for r in w.folds("signatures", "HEAD", paths=("src/new.py",)).collect()} == {("src/new.py::fn::moved", 0, 0, 0), ("src/new.py::fn::more", 3, 3, 0)}


def test_plain_folder_and_broken_sources(spark, tmp_path):
    put(tmp_path, "a/x.elm", "module X exposing (..)\n\nx : Int\nx = 1\n")
    put(tmp_path, ".gitignore", "skip\n")
    put(tmp_path, "skip/y.py", "y = 1\n")
    w = Workspace(spark, str(tmp_path))
    assert not w.is_git and w.show_text("signatures") == "== a/x.elm ==\nmodule X\n\nx : Int\n"
    put(tmp_path, "bad.py", "def (:\n")
    with pytest.raises(EngineError, match="bad.py"):
        w.show("signatures")


def test_broken_files_fail_comparisons_that_name_them(spark, tmp_path):
    run(tmp_path, "init", "-q")
    put(tmp_path, "a.py", "def f(a: int): ...\n")
    put(tmp_path, "old.py", "def (:\n")
    put(tmp_path, "docs/readme.txt", "no source\n")
    (tmp_path / "b.rs").write_bytes(b"pub fn f() {}\n")
    run(tmp_path, "add", "-A")
    run(tmp_path, "commit", "-qm", "one")
    run(tmp_path, "tag", "one")
    put(tmp_path, "c.py", "def g(): ...\n")
    run(tmp_path, "add", "-A")
    run(tmp_path, "commit", "-qm", "fine")
    run(tmp_path, "tag", "fine")
    put(tmp_path, "a.py", "def f(a: int:\n")
    run(tmp_path, "commit", "-qam", "broken")
    run(tmp_path, "tag", "broken")
    put(tmp_path, "a.py", "def f(a: str): ...\n")
    (tmp_path / "b.rs").write_bytes(b"pub fn \xff() {}\n")
    run(tmp_path, "commit", "-qam", "bytes")
    w = Workspace(spark, str(tmp_path))
    assert [r.path for r in w.diff("one", "fine", "signatures").collect()] == ["c.py"]  # old.py is broken on both sides and the same
    with pytest.raises(EngineError, match="a.py"):
        w.diff("fine", "broken", "signatures")
    with pytest.raises(EngineError, match="b.rs: not UTF-8"):
        w.diff("fine", "HEAD", "signatures")
    with pytest.raises(EngineError, match="b.rs: not UTF-8"):
        w.show("signatures", "HEAD", paths=("b.rs",))
    assert [r.path for r in w.diff("fine", "HEAD", "signatures", paths=("a.py",)).collect()] == ["a.py"]
    # a path is there whatever it holds
    assert w.show_text("signatures", "HEAD", paths=("docs",)) == "" and w.diff("one", "fine", "types", paths=("docs/readme.txt",)).count() == 0
    with pytest.raises(EngineError):
        w.show("signatures", "HEAD", paths=("doc",))
    assert [s for _, _, s in w.history("one", "HEAD")] == ["bytes", "broken", "fine"]
    steps = w.history_diffs("one", "fine", "signatures")
    assert [(s, d.count()) for _, _, s, d in steps] == [("fine", 1)]


def test_paths_against_a_folder(spark, repo):
    w = Workspace(spark, str(repo), cwd=str(repo / "src"))
    assert [w.select(p) for p in ("keep.py", "../lib.rs", "./x//y", str(repo / "lib.rs"), "..")] == ["src/keep.py", "lib.rs", "src/x/y", "lib.rs", ""]
    assert w.scope(("..", "keep.py")) == []
    with pytest.raises(EngineError):
        w.select("../../x")


def test_outlines_and_declarations_of_a_comparison(spark, repo):
    import json

    w = Workspace(spark, str(repo))
    changes = {(r.path, r.stable_key.rsplit("::", 1)[-1], r.status) for r in w.declarations("one", "HEAD", "signatures").collect()}
    assert changes == {("src/gone.py", "Gone", "deleted"), ("src/keep.py", "keep", "changed"), ("src/add.py", "VALUE", "added")}
    found = {(r.status, r.side, r.stable_key) for r in w.diff_outlines("one", "HEAD", "signatures").collect()}
    assert {(s, side) for s, side, _ in found} == {("deleted", "old"), ("added", "new"), ("modified", "old"), ("modified", "new"), ("moved", "old"), ("moved", "new")}
    doc = json.loads(w.diff_document("one", "HEAD", "signatures").first().document)
    assert [f["status"] for f in doc["files"]] == ["added", "deleted", "modified", "moved"] and doc["target"] == git.resolve_commit(str(repo), "HEAD")
    shown = json.loads(w.show_document("signatures", "HEAD").first().document)
    assert [f["path"] for f in shown["files"]] == sorted(f["path"] for f in shown["files"]) and shown["revision"] == doc["target"]
    assert {r.path for r in w.visible("signatures", "HEAD").collect()} == {f["path"] for f in shown["files"]}


def test_ignore_rules(tmp_path):
    for path in ("a.py", "b/c.py", "b/keep.py", "b/d/e.py", "out/x.py", "deep/out/y.py", "z[1].py", "log/f.py", "src/gen/a/b.py"):
        put(tmp_path, path, "")
    put(tmp_path, ".gitignore", "# note\n/out/\nb/*.py\n!b/keep.py\nz\\[1].py\nlog\nsrc/**/b.py\n")
    put(tmp_path, "b/.gitignore", "e.py\n")
    assert {p.decode() for p in git._walk(str(tmp_path)) if p.endswith(b".py")} == {"a.py", "b/keep.py", "deep/out/y.py"}


def test_areas(tmp_path):
    file = tmp_path / "areas.toml"
    file.write_text('[areas]\napi = ["src/api/", "./lib"]\nui = "web"\n')
    assert load_areas(file) == {"api": ["lib", "src/api"], "ui": ["web"]}
    for bad in ("[areas]\na = 3\n", "[other]\n", "x", '[areas]\na = "/abs"\n', '[areas]\na = "a/../b"\n'):
        file.write_text(bad)
        with pytest.raises(EngineError):
            load_areas(file)


def test_project_source():
    assert [i.name for i in project_source("m.py", b"def f(): ...\n", "signatures")] == ["f"]
    with pytest.raises(UsageError):
        project_source("m.txt", b"", "types")


def test_only_files_with_a_partner_are_hashed(spark, tmp_path):
    """Of the files on disk those are read whose language and size the other side has; what changed is found all the same."""
    run(tmp_path, "init", "-q")
    for name, text in (("same.py", "def same(): ...\n"), ("grown.py", "def a(): ...\n"), ("old.py", "class Moved: ...\n"), ("edited.py", "def b(): ...\n")):
        put(tmp_path, name, text)
    run(tmp_path, "add", "-A")
    run(tmp_path, "commit", "-qm", "one")
    run(tmp_path, "mv", "old.py", "new.py")
    put(tmp_path, "grown.py", "def a(x: int, y: int): ...\n")
    put(tmp_path, "edited.py", "def c(): ...\n")
    for i in range(30):
        put(tmp_path, f"more/f{i}.py", "x = 1\n" * (40 + i))
    w = Workspace(spark, str(tmp_path))
    entries = git.entries(spark, str(tmp_path), ":worktree", git.listed(spark, str(tmp_path), "HEAD"))
    read = {os.fsdecode(bytes(r.path)) for r in entries.where("not startswith(blob_id, 'unread:')").collect()}
    assert read == {"same.py", "edited.py", "new.py"} and entries.count() == 34
    plain = {(bytes(r.path), r.blob_id) for r in git.entries(spark, str(tmp_path), ":worktree").collect()}
    assert {(bytes(r.path), r.blob_id) for r in git.identified(entries, str(tmp_path), ":worktree").collect()} == plain
    events = {(r.status, r.old_path, r.path) for r in w.diff("HEAD", ":worktree", "signatures").collect()}
    assert events >= {("modified", "grown.py", "grown.py"), ("modified", "edited.py", "edited.py"), ("moved", "old.py", "new.py")}
    assert len(events) == 33 and not w.store.rows().where("startswith(blob_id, 'unread:')").count()
    back = {(r.status, r.old_path, r.path) for r in w.diff(":worktree", "HEAD", "signatures").collect()}
    assert ("moved", "new.py", "old.py") in back and len(back) == 33
    assert w.diff(":worktree", ":worktree", "signatures").count() == 0


def test_regions_open_and_close_with_all_below(spark, tmp_path):
    put(tmp_path, "a.py", "class A:\n    class B:\n        def m(self):\n            pass\n\n        x: int\n\n    def n(self):\n        pass\n\n\ndef f():\n    pass\n")
    w = Workspace(spark, str(tmp_path))
    rows = lambda **say: [(r.row, r.first_line, r.last_line, r.closed_text, r.suffix) for r in w.visible("signatures", **say).orderBy("row_no").collect()]
    assert rows()[0] == ("fold", 0, 8, "class A:", "  \u22ef 8 lines")
    a, b = "a.py::class::A", "a.py::class::A::class::B"
    every = rows(recursive={a: True})
    assert [r for r in every if r[0] == "fold"] == [("fold", 11, 12, "def f(): ...", "  \u22ef 1 lines")]
    inner = rows(recursive={a: True, b: False})
    assert [(r[1], r[2]) for r in inner if r[0] == "fold"] == [(1, 5), (11, 12)]
    # a single region may still say otherwise
    assert [(r[1], r[2]) for r in rows(recursive={a: True}, overrides={b: False}) if r[0] == "fold"] == [(1, 5), (11, 12)]
    assert [(r[1], r[2]) for r in rows(recursive={a: False, b: True}) if r[0] == "fold"] == [(0, 8), (11, 12)]


def test_one_file_of_the_worktree(spark, repo):
    w = Workspace(spark, str(repo), cwd=str(repo / "src"))
    assert [(r.path, r.canonical_text) for r in w.show_file("signatures", "loose.py").collect()] == [("src/loose.py", "def loose(): ...\n")]
    assert w.show_file("signatures", "../lib.rs").first().canonical_text == "pub fn f();\n"
    for bad in ("../link.rs", "../notes.txt", "gone.py", ".", "../../x.py"):
        with pytest.raises(EngineError):
            w.show_file("signatures", bad)
