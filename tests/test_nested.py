"""Ordered windows and nested sets against plain walks."""

import random

import pytest

from lithos.operators import nested, ordered


@pytest.fixture(params=[1, 9])
def ranges(request, spark):
    """Few ranges, and so many that every group is cut."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_windows_over_hot_groups(spark, ranges):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randint(-3, 3), rng.choice([None, None, f"v{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, n int, v string").repartition(3)
    from pyspark.sql import functions as F

    sums = {(r.g, r.i): r.s for r in ordered.running_sum(df, ["g"], ["i"], "n", "s").collect()}
    last = {(r.g, r.i): r.w for r in ordered.latest(df, ["g"], ["i"], "v", "w").collect()}
    near = {(r.g, r.i): (r.p and r.p.i, r.f and r.f.i) for r in ordered.neighbours(df, ["g"], ["i"], F.struct("i"), "p", "f").collect()}
    for g in {r[0] for r in rows}:
        own, total, seen = [r for r in rows if r[0] == g], 0, None
        for k, (_, i, n, v) in enumerate(own):
            total, seen = total + n, v or seen
            assert sums[g, i] == total and last[g, i] == seen
            assert near[g, i] == (own[k - 1][1] if k else None, own[k + 1][1] if k + 1 < len(own) else None)
    assert ordered.running_sum(df.limit(0), ["g"], ["i"], "n", "s").count() == 0


def walk(nodes):
    """{(g, key): (enter, exit, depth)} of nodes (g, key, parent), siblings in order of key; missing parents are roots."""
    out = {}
    for g in {n[0] for n in nodes}:
        own = {k: p for s, k, p in nodes if s == g}
        parents = own | {p: None for p in own.values() if p is not None and p not in own}
        low = {k: min([c for c, p in own.items() if p == k], default=k) if k not in own else k for k in parents}
        children = {}
        for k, p in parents.items():
            children.setdefault(p, []).append(k)
        at, stack = 0, [(k, 0, False) for k in sorted(children.get(None, []), key=lambda k: low[k], reverse=True)]
        enter = {}
        while stack:
            k, depth, leaving = stack.pop()
            if leaving:
                if k in own:
                    out[g, k] = (enter[k], at, depth)
            else:
                enter[k] = at
                stack.append((k, depth, True))
                stack += [(c, depth + 1, False) for c in sorted(children.get(k, []), key=lambda c: low[c], reverse=True)]
            at += 1
    return out


def forest(rng):
    """A deep chain with side branches in one large scope, small scopes, missing parents."""
    nodes = [(0, f"k{i:04}", None if i == 0 or rng.random() < 0.02 else f"k{max(0, i - rng.choice([1, 1, 1, 2, 5])):04}") for i in range(120)]
    nodes += [(s, f"k{i:04}", rng.choice([None, f"k{rng.randrange(i):04}" if i else None])) for s in (1, 2) for i in range(12)]
    return nodes + [(3, "b", "gone"), (3, "a", "b"), (3, "c", "gone"), (3, "d", None), (4, "only", None)]


def test_numbers_are_those_of_a_walk(spark, ranges):
    rng = random.Random(ranges)
    nodes = forest(rng)
    rng.shuffle(nodes)
    rings = [(5, "x", "y"), (5, "y", "x"), (5, "z", "x"), (5, "self", "self"), (5, "good", None)]
    df = spark.createDataFrame(nodes + rings, "g int, stable_key string, parent_key string").repartition(4)
    found = {(r.g, r.stable_key): (r.enter_no, r.exit_no, r.depth) for r in nested.nested_sets(df, ["g"], ["stable_key"]).collect()}
    want = walk(nodes) | {(5, "good"): (0, 1, 0)}
    assert found == want and max(d for _, _, d in want.values()) > 20
    assert nested.nested_sets(df.limit(0), ["g"], ["stable_key"]).count() == 0


def test_values_are_inherited_from_the_nearest_ancestor(spark, ranges):
    rng = random.Random(10 + ranges)
    nodes = forest(rng)
    parents = {(g, k): p for g, k, p in nodes}
    chosen = {n[:2]: rng.choice([True, False]) for n in nodes if rng.random() < 0.2}
    index = nested.nested_sets(spark.createDataFrame(nodes, "g int, stable_key string, parent_key string"), ["g"], ["stable_key"])
    given = spark.createDataFrame([(*k, v) for k, v in chosen.items()] + [(0, "absent", True)], "g int, stable_key string, open boolean")
    found = {(r.g, r.stable_key): r.open for r in nested.inherited(index, ["g"], given, "open").collect()}
    under = {(r.g, r.stable_key) for r in nested.below(index, ["g"], given).collect()}

    def above(g, k):
        while (k := parents.get((g, k))) is not None:
            yield g, k

    for g, k, _ in nodes:
        nearest = next((chosen[a] for a in [(g, k), *above(g, k)] if a in chosen), None)
        assert found[g, k] == nearest
        assert ((g, k) in under) == any(a in chosen for a in above(g, k))
    assert nested.inherited(index, ["g"], given.limit(0), "open").where("open is not null").count() == 0


def test_outline_rows_and_items_at_lines(spark):
    nodes = [("f", "a", None, 0, 200), ("f", "b", "a", 3, 5), ("f", "c", "a", 5, 150), ("f", "d", "c", 64, 64), ("f", "e", None, 201, 201)]
    df = spark.createDataFrame(nodes, "path string, stable_key string, parent_key string, start_line int, end_line int")
    index = nested.nested_sets(df, ["path"], ["start_line"])
    rows = nested.outline_rows(index, df, ["path"])
    assert [(r.stable_key, r.depth) for r in rows.orderBy("row_no").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 0)]
    points = spark.createDataFrame([("f", i) for i in (0, 3, 5, 64, 65, 151, 201, 500, 5)], "path string, line_no int")
    found = {r.line_no: r.stable_key for r in nested.items_at(rows, points, ["path"]).collect()}
    assert found == {0: "a", 3: "b", 5: "c", 64: "d", 65: "c", 151: "a", 201: "e"}


def test_natural_rows_and_nearest_files(spark):
    import re

    from lithos.operators import trees

    names = ["a10", "a9", "A9", "a09", "b", "B2", "é1", "e1", "_x", "z.txt", "a.b", "10", "9", "Zoo", "zoo", "a-b", "a b", "2/x9", "2/x10", "2/sub/y", "10/z", "a10x", "a10", "x" * 40 + "9" * 30, "x" * 40 + "10" * 30]
    files = spark.createDataFrame([("r", n + ("/f" if n in ("b", "Zoo") else "")) for n in dict.fromkeys(names)] + [("s", "only/dir/file")], "repo string, path string")
    nodes = trees.path_tree(files, ["repo"]).select("repo", "node", "is_file")
    rows = trees.natural_rows(nodes, ["repo"])
    found = [r.node for r in rows.where("repo = 'r'").orderBy("row_no").collect()]
    kinds = {r.node: r.is_file for r in nodes.where("repo = 'r'").collect()}
    plain = str.maketrans("é", "e")

    def key(node):
        parts = node.split("/")
        out = []
        for i, p in enumerate(parts):
            bits = [(1, int(b)) if b.isdigit() else (2 if b[0].isalpha() else 0, b) for b in re.findall("[0-9]+|[a-z]+|[^0-9a-z]+", p.lower().translate(plain))]
            out.append((i == len(parts) - 1 and kinds[node], bits, p.encode()))
        return out

    assert found == sorted(kinds, key=key)
    at = {n: i for i, n in enumerate(found)}
    last = max((n for n in found if kinds[n]), key=at.__getitem__)
    hints = spark.createDataFrame([("r", i) for i in range(len(found) + 3)] + [("s", 0), ("none", 1)], "repo string, hint long")
    got = {(r.repo, r.hint): r.node for r in trees.nearest_files(rows, ["repo"], hints).collect()}
    for i in range(len(found) + 3):
        assert got["r", i] == next((n for n in found[i:] if kinds[n]), last)
    assert got["s", 0] == "only/dir/file" and got["none", 1] is None


def counted(monkeypatch, *modules):
    """How often a table is written down by these modules from now on, as a list that grows."""
    calls = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df, own=m.cut: calls.append(1) or own(df))
    return calls


def test_a_long_walk_takes_no_more_rounds(spark, monkeypatch):
    calls = counted(monkeypatch, nested, ordered)
    chain = [(0, f"k{i:04}", f"k{i - 1:04}" if i else None) for i in range(600)]
    df = spark.createDataFrame(chain, "g int, stable_key string, parent_key string").repartition(3)
    found = {(r.g, r.stable_key): (r.enter_no, r.exit_no, r.depth) for r in nested.nested_sets(df, ["g"], ["stable_key"]).collect()}
    assert found == walk(chain) and len(calls) <= 6


def test_walks_that_enter_ranges_often_are_doubled(spark, ranges, monkeypatch):
    monkeypatch.setattr(nested, "FEW", 0)
    rng = random.Random(20 + ranges)
    names = [f"k{i:03}" for i in range(150)]
    rng.shuffle(names)
    nodes = [(s, k, rng.choice(names[:i]) if i and rng.random() < 0.97 else None) for s in (0, 1) for i, k in enumerate(names)] + [(2, "a", "gone"), (3, "x", "y"), (3, "y", "x")]
    df = spark.createDataFrame(nodes, "g int, stable_key string, parent_key string").repartition(4)
    found = {(r.g, r.stable_key): (r.enter_no, r.exit_no, r.depth) for r in nested.nested_sets(df, ["g"], ["stable_key"]).collect()}
    assert found == walk([n for n in nodes if n[0] != 3])


def test_long_spans_meet_points_without_a_row_for_each_bin(spark, ranges, monkeypatch):
    far = 1 << 40
    deep = [("long", f"s{i}", i, i, far - i) for i in range(40)]
    points = spark.createDataFrame([("long", i) for i in (0, 5, 39, 1000, far // 2, far - 39, far - 38, far, far + 1)], "path string, line_no long")
    schema = "path string, stable_key string, depth int, start_line long, end_line long"
    found = {r.line_no: r.stable_key for r in nested.items_at(spark.createDataFrame(deep, schema), points, ["path"]).collect()}
    assert found == {0: "s0", 5: "s5", 39: "s39", 1000: "s39", far // 2: "s39", far - 39: "s39", far - 38: "s38", far: "s0"}
    # spans of any shape against all of them
    monkeypatch.setattr(nested, "BIN", 4)
    rng = random.Random(ranges)
    spans = [(rng.choice("ab"), f"s{i:03}", rng.randrange(5), *sorted((rng.randrange(300), rng.randrange(300) if rng.random() < 0.4 else rng.randrange(20)))) for i in range(150)]
    asked = [(p, i) for p in "abc" for i in range(0, 310, 3)]
    got = {(r.path, r.line_no): r.stable_key for r in nested.items_at(spark.createDataFrame(spans, schema), spark.createDataFrame(asked, "path string, line_no long"), ["path"]).collect()}
    best = {(p, i): max(((d, a, k) for q, k, d, a, b in spans if q == p and a <= i <= b), default=None) for p, i in asked}
    assert got == {at: b[2] for at, b in best.items() if b}
