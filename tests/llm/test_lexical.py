"""Ranked search against scores made term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lithos.llm import lexical

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text):
    return [t.lower() if t.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall((text or "").encode())]


def expected(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in docs], "doc_id long, text string, score int, rank int, terms string, row string").repartition(3)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id string, text string, row int, counts string").repartition(2)
    return [tuple(r) for r in lexical.search(lexical.build(d), q, k).select("item_id", "rank", "doc_id", "score").collect()]


def same(a, b):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted(a, key=key) == sorted(b, key=key)


def text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "_", "\n"]) for _ in range(n))


WORDS = ["the", "The", "of", "Straße", "ÄPFEL", "äpfel", "x1", "42", "中文", "É", "rare" * 30] + [f"w{i}" for i in range(60)]


@pytest.mark.parametrize("small", [False, True])
def test_random_documents(spark, monkeypatch, small):
    """Also in blocks of two queries; shards of a few texts."""
    if small:
        monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    rng = random.Random(7)
    docs = [(i, text(rng, WORDS, rng.choice([1, 5, 40]))) for i in range(250)]
    items = [(f"q{i}", text(rng, WORDS, rng.randint(1, 12))) for i in range(9)]
    assert same(found(spark, docs, items), expected(docs, items))


def test_ties_go_to_the_smaller_id_and_repeats_count(spark):
    """A third of the rows are copies; repeated ids and rows, null ids last, nulls and blanks never found."""
    copies = [(i, "same words here") for i in range(200, 100, -1)]
    rest = [(7, "same"), (7, "same"), (None, "same words here"), (None, None), (8, None), (9, ""), (10, " ., -"), (11, "other same")]
    items = [("a", "same words same"), ("a", "same words same"), (None, "here"), ("none", "absent"), ("null", None), ("blank", "--"), ("c", "other")]
    docs = copies + rest
    assert same(found(spark, docs, items), expected(docs, items))
    assert same(found(spark, docs, items, k=150), expected(docs, items, k=150))


def test_terms_that_all_documents_hold_weigh_nothing(spark):
    docs = [(i, "all") for i in range(2000)]
    assert same(found(spark, docs, [("a", "all")]), expected(docs, [("a", "all")]))


def test_empty_tables(spark):
    assert found(spark, [], [("a", "x")]) == [] and found(spark, [(1, "x")], []) == [] and found(spark, [(1, None)], [("a", "x")]) == []
    with pytest.raises(ValueError, match="whole numbers"):
        lexical.build(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_best_is_safe_with_ties():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        score, order = rng.integers(0, 4, n), rng.permutation(n)
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-score[i], order[i]))[:k]
        assert sorted(lexical.best(score, order, k).tolist()) == sorted(want)


def test_impacts_of_lengths_beyond_64_bits():
    tf, n = np.array([1, 10**8]), np.array([10**9, 10**9])
    whole = [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 10**12 // 10**14)) for t, m in zip(tf.tolist(), n.tolist(), strict=True)]
    assert lexical.impacts(tf, n, 10**12, 10**14).tolist() == whole
