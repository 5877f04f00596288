"""Merkle manifests against trees made plainly."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lithos.llm import manifest

SCHEMA = "g string, path string, doc_id long, source string, lang string, n_chars int, text string, digest int, place int, row int, n int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    """Root, and each leaf's siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append((run[: i % 16], run[i % 16 + 1 :]))
            at[k] = i // 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = [tree([leaf(r, r[4]) for r in groups[g]]) for g in order]
    root, top = tree([t[0] for t in trees])
    out = []
    for g, (sub, paths), above in zip(order, trees, top, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            path = path + above
            own = node = leaf(r, r[4])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(r, None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            out.append((r[0], own, sub, root, sha("".join("".join(a + b) for a, b in path)), node, node == root))
    return out


def found(spark, rows):
    # columns that the operator uses itself, and one more, come with the rows
    df = spark.createDataFrame([("x", "y", *r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.digest_of([*map(F.col, FIELDS[:-1]), manifest.ascii_lower(F.col("text"))]))
    got = manifest.verify(manifest.manifest(df, FIELDS, changed=lowered))
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def same(a, b):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 1, None: 2}, {"hot": 4700, "": 17, None: 257, "é": 16, "z": 1, "A": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_trees_and_proofs(spark, sizes):
    rng = random.Random(1)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            text = rng.choice([None, "", "Größe ÄÖ ABC", "plain lower", "Upper", "😀 Σ İ"])
            rows.append((i * 7 % 100_003, source, rng.choice([None, "en"]), rng.choice([None, 3]), text))
    assert same(found(spark, rows), expected(rows))


def test_repeated_rows_null_ids_and_none(spark):
    """Rows of one id are ordered by leaf, equal rows are leaves of their own, null ids come first."""
    rows = [(5, "a", "en", 1, "Same")] * 40 + [(5, "a", "en", 1, f"Other {i}") for i in range(20)] + [(None, "a", None, None, None)] * 3 + [(None, None, None, None, None)]
    assert same(found(spark, rows), expected(rows))
    assert found(spark, []) == []


def test_frontiers_of_many_ranges(spark, monkeypatch):
    """More ranges than runs: nearly every parent lacks children when its task ends, and rounds of one level still end."""
    monkeypatch.setattr(manifest, "ROUND", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "hot", None, 1, "Xy") for i in range(300)] + [(i, f"s{i % 20}", None, 1, "Xy") for i in range(300, 500)]
        assert same(found(spark, rows), expected(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_partials_complete_in_any_order():
    rng = random.Random(2)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(1000)]
    partials = manifest.Partials()
    for i in rng.sample(range(1000), 1000):
        partials.arrive("g", 1000, 0, i, leaves[i])
    assert not partials.open
    roots = [d for kind, *_, d in partials.done if kind == "root"]
    assert [r.hex() for r in roots] == [tree([x.hex() for x in leaves])[0]]
    assert sum(kind == "link" for kind, *_ in partials.done) == 63 + 4 + 1
