"""Comparison rules at their limits, lines, trees and folds."""

import random

from pyspark.sql import functions as F

from lithos.operators import comparison, documents, folds, lines, projection, search, trees
from lithos.plans import virtual

ENTRY = "repo string, path string, language string, text string"


def entries(spark, rows):
    df = spark.createDataFrame(rows, ENTRY)
    return df.withColumn("blob_id", F.sha1("text")).withColumn("size", F.octet_length("text").cast("long"))


def events(base, target):
    return {(r.status, r.old_path, r.path, r.score) for r in comparison.comparison_plan(base, target).collect()}


def test_pairs_at_the_least_score(spark):
    old = entries(spark, [("r", "a", "x", "p" * 50 + "q" * 50), ("r", "c", "x", "m" * 49 + "n" * 51)])
    new = entries(spark, [("r", "b", "x", "p" * 50 + "s" * 50), ("r", "d", "x", "m" * 49 + "o" * 51)])
    assert events(old, new) == {("moved", "a", "b", 50), ("deleted", "c", None, None), ("added", None, "d", None)}


def test_languages_repos_and_sizes_part_pairs(spark):
    text = "line of text\n" * 10
    old = entries(spark, [("r", "a", "x", text), ("s", "a", "x", text + "1"), ("t", "a", "x", "t" * 100), ("u", "a", "x", "")])
    new = entries(spark, [("r", "b", "y", text + "2"), ("v", "b", "x", text + "1"), ("t", "b", "x", "t" * 201), ("u", "b", "x", "u")])
    assert {s for s, *_ in events(old, new)} == {"added", "deleted"}


def test_copies_pair_in_order_of_path(spark):
    old = entries(spark, [("r", p, "x", "same") for p in ("a2", "a1", "a3")])
    new = entries(spark, [("r", p, "x", "same") for p in ("b9", "b8")])
    assert events(old, new) == {("moved", "a1", "b8", None), ("moved", "a2", "b9", None), ("deleted", "a3", None, None)}
    kept = entries(spark, [("r", "a1", "x", "same"), ("r", "b", "x", "same")])
    assert events(entries(spark, [("r", "a1", "x", "same")]), kept) == {("added", None, "b", None)}


def test_side_cap(spark):
    def side(prefix, n):
        return [("r", f"{prefix}{i}", "x", f"{i:04d} " + "shared words in all of them " * 4) for i in range(n)]

    assert any(s == "moved" for s, *_ in events(entries(spark, side("a", 20)), entries(spark, [(r, p, l, t + prefix) for prefix in "z" for r, p, l, t in side("b", 20)])))
    big = entries(spark, [(r, "b" + p, l, t + "z") for r, p, l, t in side("a", comparison.SIDE_CAP + 1)])
    assert {s for s, *_ in events(entries(spark, side("a", 20)), big)} == {"added", "deleted"}


def test_greedy_choice(spark):
    rows = [("r", "a", "x", 90), ("r", "a", "y", 95), ("r", "b", "y", 95), ("r", "b", "x", 60), ("s", "a", "x", 50)]
    found = comparison.greedy_moves(spark.createDataFrame(rows, "repo string, old_path string, path string, score int")).collect()
    assert {(r.repo, r.old_path, r.path) for r in found} == {("r", "a", "y"), ("r", "b", "x"), ("s", "a", "x")}


def test_plan_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        plans.append(events(virtual.base(docs), virtual.target(docs)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plans[0] == plans[1] and {s for s, *_ in plans[0]} == {"added", "deleted", "modified", "moved"}


def test_bounds_hold_scores(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé\n") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    old, new = entries(spark, [("r", f"a{i}", "x", t) for i, t in enumerate(texts[:6])]), entries(spark, [("r", f"b{i}", "x", t) for i, t in enumerate(texts[6:])])
    status = comparison.snapshot_status(old, new)
    bounds = comparison.frequency_bounds(comparison.eligible_pairs(*comparison.leftovers(status, comparison.exact_moves(status))), old, new)
    scores = {(r.old_path, r.path): r.score for r in comparison.similarity_scores(bounds, old, new, 1).collect()}
    ceilings = {(r.old_path, r.path): r.ceiling for r in bounds.collect()}
    assert scores and all(s <= ceilings[k] for k, s in scores.items())


def test_moved_declarations_are_rebased(spark):
    side = "repo string, path string, stable_key string, parent_key string, text string, retained boolean"
    old = spark.createDataFrame([("r", "a.py", "a.py::class::C", None, "class C", True), ("r", "a.py", "a.py::class::C::method::m", "a.py::class::C", "m()", True), ("r", "a.py", "impl X", None, "x", True)], side)
    new = spark.createDataFrame([("r", "b.py", "b.py::class::C", None, "class C2", True), ("r", "b.py", "b.py::class::C::method::m", "b.py::class::C", "m(x)", True), ("r", "b.py", "impl X", None, "x", True), ("r", "b.py", "b.py::fn::n", None, "n", False)], side)
    renames = spark.createDataFrame([("r", "a.py", "b.py")], "repo string, old_path string, path string")
    found = comparison.declaration_changes(old, new, renames).collect()
    assert [(r.stable_key, r.status) for r in found] == [("b.py::class::C::method::m", "changed")]


def test_lines_past_the_third_are_declarations(spark, tmp_path):
    from lithos import catalog

    text = "\n".join(f"line {i}" for i in range(1, 8))
    docs = [(3, text, "en", "r"), (10, "one", "en", "r"), (7, text, "en", "r"), (4, text + "\nmoved", "en", "r"), (2, text, "en", "r")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.stable_key, r.status) for r in catalog.QUERIES["stable_key_join"](spark, str(tmp_path)).collect()}
    new = {(f"en/00000007.txt::{i}", "added") for i in range(2, 8)}
    assert found == {("en/00000003.txt::7", "changed"), ("en/00000010.txt::1", "changed")} | new


def test_lines(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc\n", "a\nx\ny\nc\n"), (2, None, "n"), (3, "", "")], "id long, old_text string, new_text string")
    rows = lines.aligned_rows(pairs, ["id"])
    assert [(r.kind, r.old_no, r.new_no) for r in rows.where("id = 1").orderBy("row_no").collect()] == [("equal", 1, 1), ("change", 2, 2), ("add", None, 3), ("equal", 3, 4)]
    assert {r.id: (r.added, r.removed) for r in lines.diff_stats(rows, ["id"]).collect()} == {1: (2, 1), 2: (1, 0)}
    assert {r.id: r.hunks for r in lines.unified_hunks(pairs, ["id"]).collect()}[3] == ""
    flags = spark.createDataFrame([(1, i, i in (0, 7, 30)) for i in range(40)], "id long, row_no int, changed boolean")
    windows = lines.hunk_windows(flags, ["id"])
    assert [(r.first_row, r.last_row, r.changes) for r in windows.orderBy("hunk_no").collect()] == [(0, 10, 2), (27, 33, 1)]
    assert [r.hidden for r in lines.collapsed_gaps(windows, ["id"]).collect()] == [16]


def test_closures_and_errors(spark):
    links = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(40)] + [(1, 1, 2), (1, 2, 1), (1, 5, 5)], "g int, node int, parent int")
    found = trees.closure(links, ["g"])
    assert found.where("g = 0").count() == 40 * 39 // 2 and found.where("g = 0 and node = 39 and ancestor = 0").first().distance == 39
    nodes = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", "b"), (1, "c", "zz"), (1, "d", "e"), (1, "e", "d"), (1, "f", "d")], "g int, stable_key string, parent_key string")
    assert {(r.stable_key, r.error) for r in trees.forest_errors(nodes, ["g"]).collect()} == {("a", "duplicate_key"), ("b", "self_parent"), ("c", "dangling_parent"), ("d", "cyclic_parent"), ("e", "cyclic_parent")}


def test_history_and_merge_bases(spark):
    commits = spark.createDataFrame([(0, "c", "b"), (0, "b", "a"), (0, "a", None)], "g int, commit string, parent string")
    at = lambda c: spark.createDataFrame([(0, c)], "g int, commit string")
    assert [(r.parent, r.commit, r.position) for r in trees.history_steps(commits, ["g"], at("c"), at("a")).orderBy("position").collect()] == [("b", "c", 1), ("a", "b", 2)]
    assert trees.history_steps(commits, ["g"], at("c"), at("c")).count() == 0
    assert [(r.parent, r.position) for r in trees.history_steps(commits, ["g"], at("a"), at("c")).collect()] == [(None, 0)]
    graph = spark.createDataFrame([("r", None), ("m", "r"), ("x", "m"), ("y", "m"), ("z", "y")], "commit string, parent string")
    assert [r.commit for r in trees.merge_base(graph, "x", "z").collect()] == ["m"] and [r.commit for r in trees.merge_base(graph, "y", "z").collect()] == ["y"]


def test_folds():
    source = "import a\n\n# about f\n@wrap(\n    1\n)\ndef f():\n    pass\nx = 1\n# plain\ndef g():\n    pass\n"
    items = [{"stable_key": k, "parent_key": None, "kind": "function", "start_line": a, "end_line": b, "retained": r} for k, a, b, r in (("f", 6, 7, True), ("x", 8, 8, False), ("g", 10, 11, True))]
    found = folds.regions(items, source)
    assert [(r.key, r.start, r.declaration, r.end) for r in found] == [("f", 2, 6, 7), ("x", 8, 8, 8), ("g", 10, 10, 11)]
    rows = folds.visible_rows(found, 13, "signatures")
    assert rows == [("source", 0, 0, None), ("source", 1, 1, None), ("fold", 2, 7, "f"), ("fold", 8, 8, "x"), ("source", 9, 9, None), ("fold", 10, 11, "g"), ("source", 12, 12, None)]
    assert folds.visible_rows(found, 13, "types", {"f": True})[:2] == [("source", 2, 2, None), ("source", 3, 3, None)]
    assert folds.visible_rows(found, 13, "tests") == [("fold", 2, 7, "f"), ("fold", 10, 11, "g")]


def test_annotations_above_declarations():
    def start(source, line):
        return folds.fold_start(source.split("\n"), line, lambda n: n == 0)

    assert start("x\n/*! inner\n doc */\nf", 3) == 1 and start("x\n/* plain\n end */\nf", 3) == 3  # a plain comment stays with what is above it
    assert start("x\n-- | doc\nf", 2) == 2 and start("x\n{-| doc -}\nf", 2) == 1
    assert start("x\n@wrap(a[0],\n\n  ')')\nf", 4) == 1 and start("x\n#[doc = \")]\"]\nf", 2) == 1
    assert start("#!/bin/sh\nf", 1) == 1


def test_folds_of_many_items_in_linear_time():
    import time

    items = [{"stable_key": f"f{n}", "parent_key": None, "kind": "function", "start_line": 2 * n, "end_line": 2 * n, "retained": True} for n in range(20000)]
    began = time.process_time()
    assert len(folds.regions(items, "def f(): ...\n# note\n" * 20000)) == 20000 and time.process_time() - began < 10


def test_large_alignments_are_divided(monkeypatch):
    import random

    from lithos.functions import sequences

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(2))
        monkeypatch.setattr(sequences, "ROW_BITS", 1 << 28)
        whole = sequences.common_units(a, b)
        monkeypatch.setattr(sequences, "ROW_BITS", 16)
        parts = sequences.common_units(a, b)
        assert len(parts) == len(whole) == sequences.common_length(a, b)
        assert all(a[i] == b[j] for i, j in parts) and all(x < y for p, q in zip(parts, parts[1:]) for x, y in zip(p, q))


def test_visible_rows_of_files(spark):
    source = "class A:\n    def f(self): ...\n\n\nx = 1\n"
    files = spark.createDataFrame([("r", "a.py", "python", source), ("r", "b.py", "python", "")], ENTRY)
    found = folds.fold_regions(projection.outline(projection.items(files, ["repo", "path"]), ["repo", "path"], "signatures"), files, ["repo", "path"])
    rows = folds.visible(found, files, ["repo", "path"], "signatures").orderBy("row_no").collect()
    assert [(r.path, r.row, r.first_line, r.last_line) for r in rows][0] == ("a.py", "fold", 0, 1) and rows[-1].row in ("fold", "source") and rows[0].text == "class A:"
    opened = folds.visible(found, files, ["repo", "path"], "signatures", {"a.py::class::A": True}).orderBy("row_no").collect()
    assert len(opened) >= len(rows)


def test_search(spark):
    texts = spark.createDataFrame([(1, "Aa a\nb\nÉa"), (2, None)], "id long, text string")
    assert [(r.line_no, r.matches) for r in search.line_matches(texts, ["id"], "A").orderBy("line_no").collect()] == [(0, 3), (2, 1)]
    assert [(r.line_no, r.start, r.end) for r in search.match_offsets(texts, ["id"], "éa").collect()] == [(2, 0, 3)]
    assert search.line_matches(texts, ["id"], "").count() == 0
    names = spark.createDataFrame([("alpha beta", 0), ("ab", 1), ("xyz", 2)], "name string, position int")
    assert [r.name for r in search.fuzzy_rank(names, "ab").collect()] == ["ab", "alpha beta"]


def test_json_documents(spark):
    import json

    def rows(source):
        return projection.items(spark.createDataFrame([("r", "a.py", "python", source), ("r", "b.py", "python", "")], ENTRY), ["repo", "path"])

    old, new = rows("class A:\n    x: int\n"), rows("class A:\n    y: int\n\ndef f(): ...\n")
    files = spark.createDataFrame([("r", "a.py", "python"), ("r", "b.py", "python")], "repo string, path string, language string")
    shown = json.loads(documents.show_document(new, files, "types", None).first().document)
    assert [f["path"] for f in shown["files"]] == ["a.py", "b.py"] and [i["name"] for i in shown["files"][0]["projection"]["items"]] == ["A", "y"]
    assert shown["files"][0]["projection"]["text"] == "class A:\n    y: int\n" and shown["files"][1]["projection"] == {"text": "", "items": []} and shown["mode"] == "types"
    assert [(o["name"], o["retained_in_mode"]) for o in shown["files"][0]["outline"]] == [("A", True), ("y", True), ("f", False)]
    events = spark.createDataFrame([("r", "modified", "a.py", "a.py", "python")], "repo string, status string, old_path string, path string, language string")
    made = json.loads(documents.diff_document(events, old, new, "types", "one", "two").first().document)
    assert made["files"][0]["base"]["projection"]["items"][1]["name"] == "x" and made["files"][0]["target"]["projection"]["items"][1]["name"] == "y" and made["base"] == "one"


def test_subtrees(spark):
    rows = [("r", "a", None), ("r", "a.b", "a"), ("r", "a.b.c", "a.b"), ("r", "x", None), ("q", "a", None), ("q", "a.z", "a"), ("r", "loop", "pool"), ("r", "pool", "loop")]
    nodes = spark.createDataFrame(rows, "repo string, stable_key string, parent_key string")
    assert {tuple(r) for r in folds.subtree_keys(nodes, ["repo"], "a").collect()} == {("r", "a.b"), ("r", "a.b.c"), ("q", "a.z")}
    assert {tuple(r) for r in folds.subtree_keys(nodes, ["repo"], "loop").collect()} == {("r", "pool")}


def test_widths_and_columns(spark):
    pairs = spark.createDataFrame([(1, "a\n" * 9, "a\n" * 10 + "bbbbbb"), (2, None, "n")], "id long, old_text string, new_text string")
    rows = lines.aligned_rows(pairs, ["id"])
    assert {tuple(r) for r in lines.gutter_widths(rows, ["id"]).collect()} == {(1, 1, 2), (2, 1, 1)}
    last = lines.side_by_side(rows.where("id = 1"), ["id"], 4).orderBy(F.desc("row_no")).first()
    assert (last.left, last.right) == (["", ""], ["bbbb", "bb"])
    assert [tuple(r) for r in lines.line_widths(pairs, ["id"], "old_text").orderBy("id").collect()] == [(1, 10, 1), (2, 1, 0)]


def test_matches_step_around(spark):
    hits = search.line_matches(spark.createDataFrame([(1, "a\nb\na\na"), (2, "a")], "id long, text string"), ["id"], "a")
    assert {tuple(r) for r in search.match_steps(hits, ["id"]).collect()} == {(1, 0, 2, 3), (1, 2, 3, 0), (1, 3, 0, 2), (2, 0, 0, 0)}
