"""Histories as one plan against one comparison a step; contents read, scored and parsed once."""

import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import comparison, history
from lithos.operators.store import ProjectionStore
from lithos.plans.lineage import new_path
from lithos.workspace import EngineError, Workspace
from tests.test_workspace import put, run


def snapshots(rng):
    """{repo: [{path: (language, text)}]}: files come, go, return, move and change; one repo ends empty, one has one snapshot."""
    out = {}
    for repo, n in (("long", 14), ("short", 1), ("ends", 4)):
        now, all_ = {}, []
        for i in range(n):
            for _ in range(3):
                path = f"d{rng.randrange(3)}/f{rng.randrange(5)}.py"
                if path in now and rng.random() < 0.5:
                    text = now.pop(path)
                    if rng.random() < 0.6:
                        now[f"m{i}/{path}"] = text if rng.random() < 0.5 else (text[0], text[1] + "x")
                else:
                    now[path] = ("py", "".join(rng.choice("abc") for _ in range(30)))
            if repo == "ends" and i == n - 1:
                now = {}
            all_.append(dict(now))
        out[repo] = all_
    return out


ENTRY = "repo string, position long, path string, language string, blob_id string, size long, text string"


def test_steps_in_one_plan_are_those_compared_alone(spark):
    from lithos.functions.blobs import content_id

    found, rows = snapshots(random.Random(4)), []
    for repo, all_ in found.items():
        rows += [(repo, i, path, lang, text, len(text), text) for i, files in enumerate(all_) for path, (lang, text) in files.items()]
    entries = spark.createDataFrame(rows, ENTRY).withColumn("blob_id", content_id(F.col("text"))).repartition(5)
    last = spark.createDataFrame([(repo, len(all_) - 1) for repo, all_ in found.items()], "repo string, last long")
    deltas = history.snapshot_deltas(entries.drop("text"), last)
    texts = entries.select("blob_id", "text").dropDuplicates(["blob_id"])
    got = {tuple(r) for r in history.step_events(deltas, lambda asked: texts.join(asked, "blob_id", "left_semi")).collect()}
    want = set()
    for repo, all_ in found.items():
        for step in range(1, len(all_)):
            side = lambda i, repo=repo: entries.where((F.col("repo") == repo) & (F.col("position") == i))
            for r in comparison.comparison_plan(side(step - 1), side(step)).collect():
                want.add((repo, step, r.status, r.old_path, r.path, r.language, r.score))
    assert got == want
    assert {"added", "deleted", "modified", "moved"} == {w[2] for w in want} and any(w[6] for w in want)
    assert history.snapshot_deltas(entries.drop("text").limit(0), last).count() == 0


def test_texts_of_equal_contents_move_once(spark):
    base = spark.createDataFrame([(f"r{i}", f"old{i}.py", "py", "o", 40, "abcde" * 8) for i in range(20)], "repo string, path string, language string, blob_id string, size long, text string")
    target = spark.createDataFrame([(f"r{i}", f"new{i}.py", "py", "n", 41, "abcde" * 8 + "x") for i in range(20)], "repo string, path string, language string, blob_id string, size long, text string")
    pairs = comparison.eligible_pairs(*comparison.pairing(base, target)[2:])
    assert pairs.count() == 20 and comparison.content_pairs(pairs).count() == 1
    scores = comparison.similarity_scores(pairs, base, target).collect()
    assert len(scores) == 20 and {r.score for r in scores} == {97}
    # a text is read for its content, not for its paths
    asked = []
    events = comparison.comparison_plan(comparison.Lazy(base.drop("text"), lambda w: asked.append(w.count()) or w.join(base.select("repo", "path", "text"), ["repo", "path"])), target)
    assert {(r.status, r.score) for r in events.collect()} == {("moved", 97)} and asked == [1]


def test_a_store_parses_each_content_once(spark):
    text = "def f(a: int) -> int: ...\n"
    files = spark.createDataFrame([("a.py", "python", "1", text), ("b/c.py", "python", "1", text), ("d.py", "python", "2", "def ("), ("e.py", "python", "3", ""), ("f.txt", "text", "4", "x"), ("g.rs", "rust", "1", "fn f() {}"), ("h.py", "python", None, text)], "path string, language string, blob_id string, content string")
    path, read = new_path(spark, "store"), []
    store = ProjectionStore(spark, path)
    fill = lambda s, rows: s.fill(rows, lambda w: read.append(w.count()) or w)
    assert fill(store, files) == 4 and read == [4]
    assert fill(store, files) == 0 and read == [4]
    again = ProjectionStore(spark, path)
    more = files.withColumn("path", F.concat(F.lit("moved/"), "path")).unionAll(spark.createDataFrame([("new.py", "python", "5", "X: int = 1\n")], files.schema))
    assert fill(again, more) == 1 and read == [4, 1]
    rows = again.items(files.where("blob_id is not null"), ["path"])
    found = {(r.path, r.stable_key, r.mode) for r in rows.where("error is null").collect()}
    assert found == {(p, f"{p}::fn::f", "signatures") for p in ("a.py", "b/c.py", "g.rs")}
    assert [r.path for r in rows.where("error is not null").collect()] == ["d.py"]
    assert again.items(more, ["path"]).where("path = 'new.py' and mode = 'signatures'").count() == 1


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    run(root, "init", "-q")
    body = "".join(f"def f{i}(a: int) -> int:\n    return {i}\n\n\n" for i in range(6))
    put(root, "a.py", body)
    put(root, "same.py", "def same(): ...\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "start")
    run(root, "tag", "start")
    run(root, "mv", "a.py", "b.py")
    put(root, "b.py", body + "def more(): ...\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "move and edit")
    put(root, "b.py", body)
    put(root, "odd name\t.rs", "pub fn g() {}\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "back")
    run(root, "rm", "-q", "same.py")
    put(root, "notes.txt", "x")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "gone")
    put(root, "same.py", "def same(): return 2\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "again")
    return str(root)


def test_a_history_in_one_plan(spark, repo):
    w = Workspace(spark, repo)
    steps = w.history("start", "HEAD")
    whole = {tuple(r) for r in w.history_diff("start", "HEAD", "signatures").select("subject", "status", "old_path", "path", "score", "old_text", "new_text").collect()}
    alone = Workspace(spark, repo)
    want = {(s, r.status, r.old_path, r.path, r.score, r.old_text, r.new_text) for p, c, s in steps for r in alone.diff(p, c, "signatures").collect()}
    assert whole == want and {x[0] for x in whole} == {"move and edit", "back", "gone", "again"}
    assert [(s, d.count()) for _, _, s, d in w.history_diffs("start", "HEAD", "signatures")] == [(s, sum(x[0] == s for x in want)) for _, _, s in steps]
    events = {(r.step, r.status) for r in w.history_events("start", "HEAD").collect()}
    assert events == {(1, "moved"), (2, "modified"), (2, "added"), (3, "deleted"), (4, "added")}
    # contents of all steps: two of a.py, same.py twice, one of Rust
    assert w.store.rows().select("blob_id", "language").distinct().count() == 5
    assert list(w.history_diffs("HEAD", "HEAD", "types")) == []
    assert {r.path for r in w.history_diff("start", "HEAD", "signatures", paths=("same.py",)).collect()} == {None, "same.py"}


def test_a_step_that_does_not_parse_is_an_error(spark, tmp_path):
    run(tmp_path, "init", "-q")
    for i, text in enumerate(("def a(): ...\n", "def (\n", "def b(): ...\n")):
        put(tmp_path, "x.py", text)
        run(tmp_path, "add", "-A")
        run(tmp_path, "commit", "-qm", f"c{i}")
    w = Workspace(spark, str(tmp_path))
    with pytest.raises(EngineError, match="x.py"):
        w.history_diff("HEAD~2", "HEAD", "signatures")
    assert w.history_events("HEAD~2", "HEAD").count() == 2


def counted(monkeypatch, *modules):
    """How often a table is written down by these modules from now on, as a list that grows."""
    calls = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df, own=m.cut: calls.append(1) or own(df))
    return calls


def test_moves_and_leftovers_come_from_one_pass(spark, monkeypatch):
    calls = counted(monkeypatch, comparison)
    entry = "repo string, path string, language string, blob_id string, size long"
    base = [("r", "a1", "py", "x", 3), ("r", "a2", "py", "x", 3), ("r", "a3", "rs", "x", 3), ("r", "n1", None, "z", 1), ("s", "a1", "py", "x", 3), ("r", "same", "py", "q", 2)]
    target = [("r", "b2", "py", "x", 3), ("r", "b9", "py", "y", 4), ("r", "n2", None, "z", 1), ("r", "b1", "rs", "x", 3), ("r", "b3", "rs", "x", 3), ("r", "same", "py", "p", 2)]
    events = comparison.comparison_plan(spark.createDataFrame(base, entry), spark.createDataFrame(target, entry), fuzzy=False)
    assert {(r.repo, r.status, r.old_path, r.path) for r in events.collect()} == {
        ("r", "moved", "a1", "b2"), ("r", "moved", "a3", "b1"), ("r", "modified", "same", "same"), ("r", "deleted", "a2", None), ("r", "deleted", "n1", None), ("s", "deleted", "a1", None),
        ("r", "added", None, "b9"), ("r", "added", None, "b3"), ("r", "added", None, "n2"),
    }
    assert len(calls) == 2


def test_deltas_are_written_down_once(spark, monkeypatch):
    from lithos.operators import ordered

    calls = counted(monkeypatch, history, ordered)
    rows = [("r", i, f"p{k}", "py", f"b{(i * k) % 3}", 1) for i in range(8) for k in range(5) if (i + k) % 4]
    entries, last = spark.createDataFrame(rows, ENTRY.rpartition(",")[0]), spark.createDataFrame([("r", 9)], "repo string, last long")
    got = {(r.step, r.path): (r.old_blob, r.new_blob) for r in history.snapshot_deltas(entries, last).collect()}
    at = [{p: b for _, i, p, _, b, _ in rows if i == n} for n in range(10)]
    assert got == {(n, p): (at[n - 1].get(p), at[n].get(p)) for n in range(1, 10) for p in at[n - 1].keys() | at[n].keys() if at[n - 1].get(p) != at[n].get(p)}
    assert len(calls) == 1
