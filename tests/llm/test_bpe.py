"""Byte-level BPE against the library that defines it, and its round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lithos.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.of(bpe.RANKS)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def check(vocabulary, library, texts):
    ids, off = vocabulary.encode(texts)
    for i, text in enumerate(texts):
        own = ids[off[i] : off[i + 1]]
        assert own.tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(own) == text.encode()


def letters(rng, n):
    return "".join(chr(rng.randint(97, 122)) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_any_text(vocabulary, library, texts):
    check(vocabulary, library, texts)


def test_every_length_bucket(vocabulary, library):
    rng = random.Random(3)
    sizes = sorted({n for b in bpe.BUCKETS for n in (b - 1, b, b + 1)})
    check(vocabulary, library, [letters(rng, n) for n in sizes for _ in range(4)] + ["a" * n for n in sizes] + ["ab" * n for n in sizes] + ["中文字" * n for n in (1, 60, 170, 171, 400)])


def test_one_letter_between_others(vocabulary, library):
    """White space, marks and digits of all scripts cut as the library cuts them."""
    check(vocabulary, library, [f"a{chr(c)}b1{chr(c)} {chr(c)}{chr(c)}x" for c in range(0x3100) if not 0xD800 <= c < 0xE000])


def test_long_pieces_by_heap_as_by_matrix(vocabulary):
    rng = random.Random(4)
    for n in (2, 3, 40, 300, 512):
        for piece in (letters(rng, n).encode(), b"a" * n, bytes(rng.randrange(256) for _ in range(n))):
            row, size = vocabulary.merge(vocabulary.byte[np.frombuffer(piece, np.uint8)][None, :], np.array([n]))
            assert row.tolist() == vocabulary.merge_long(piece).tolist() and len(row) == size[0]


def test_long_texts_in_portions(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PORTION", 7)
    rng = random.Random(5)
    check(vocabulary, library, [" ".join(letters(rng, rng.randint(1, 9)) for _ in range(200)), "", "short", "x  \n\n  y " * 50, letters(rng, 2000)])


def test_what_is_remembered_is_bounded(library, monkeypatch):
    own = bpe.Vocabulary(bpe.Vocabulary.of(bpe.RANKS).ranks)
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "PORTION", 20)
    rng = random.Random(6)
    for _ in range(10):
        check(own, library, [" ".join(letters(rng, 6) for _ in range(30)) for _ in range(5)])
        assert len(own.places) <= 50 + 20 + 60


def test_a_vocabulary_whose_merges_go_back(library):
    """Ranks in which a made token pairs at a lower rank than the pair that made it."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"bc": 300, b"abc": 1, b"abcd": 301, b"cd": 299}
    own, ref = bpe.Vocabulary(ranks), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcbcd", "cdabcabcdbc" * 5, "bcbcbccd", "abcd" * 200):
        ids, _ = own.encode([text])
        assert ids.tolist() == ref.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bad_vocabularies_and_ids(vocabulary):
    with pytest.raises(ValueError, match="no rank"):
        bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError, match="vocabulary"):
        vocabulary.decode(np.array([1 << 20], np.uint32))


def test_documents(spark, library):
    """Nulls and empty texts have no ids; repeated rows, ids of any type, other columns; empty tables."""
    texts = [None, "", "Hello  world <|endoftext|>", "Hello  world <|endoftext|>", "naïve\t\r\n 漢字 𐍈"]
    rows = [(str(i) if i else None, t, "ids", 1, b"d") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key string, t string, ids string, n_tokens int, decoded binary")
    encoded = bpe.encode(df, id_col="key", text_col="t")
    got = sorted((r["doc_id"] or "", r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(encoded).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((str(i) if i else "", len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)
    assert bpe.decode(bpe.encode(df.limit(0), id_col="key", text_col="t")).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id int, ids binary")
    assert bpe.decode(nulls).first().decoded is None
