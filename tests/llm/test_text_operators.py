"""The text operators against brute force, on the small tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lithos.llm import chat, decontaminate, license_rules, licenses, merkle, minhash, packing, pii, queries, shared, style_tree, token_files, toxicity
from lithos.llm.shared import new_path
from lithos.llm.tokens import Encoder

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Null, empty, blank, one word, ties, a long text, repeated rows and ids, odd white space, control strings.
ODD = [
    (5, None), (6, ""), (7, " \n\t "), (8, "word"), (9, "a b c d e f g h i j"), (10, "a b c d e f g h i j"), (10, "a b c d e f g h i j"),
    (11, "x" * 20000 + " " + "lorem ipsum dolor " * 3000), (12, "two  blanks and\ttabs here<|endoftext|> é"), (13, "+1 (314) 555-6532 4663622617512349 Ärger"), (None, "no id at all here it is"),
]


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", None) for i, t in ODD], "doc_id long, text string, t string, n_chars long, bucket string, restored string, d string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, t string")


def shingle_set(text, k):
    words = re.findall(r"[^ \x09-\x0d]+", (text or "").translate(_LOW))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@lru_cache
def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def library_ids(name, text, end):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def thue_morse(size):
    """A text of two letters and its complement, which collide under every polynomial modulo a power of two."""
    a = "a"
    while len(a) < size:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_and_units_are_known_by_their_text(spark):
    for name, leads in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for size in (32, 64, 1024, 4096):
            a, b = thue_morse(size)
            encoder = Encoder(name, leads)
            got = encoder.encode([a, b, a])
            assert [list(x) for x in got] == [list(x) for x in encoder.whole([a, b, a])] and list(got[0]) != list(got[1])
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(docs, 3, 85).collect())
    items = spark.createDataFrame([(9, b)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, items).collect()] == [2]


def test_a_unit_under_another_ones_key_is_noticed(monkeypatch):
    """With a hash of one value for all units, every unit still has its own ids."""
    from lithos.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, size: np.full(len(start), 77, np.uint64))
    encoder = Encoder("byte_bpe_50k.json", True)
    texts = ["some words, and other words", "and words again: a very long one " + "x" * 100, ""]
    assert [list(x) for x in encoder.encode(texts)] == [list(x) for x in encoder.whole(texts)]


# -- near duplicates ---------------------------------------------------------


def classes(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, small, docs, k, percent):
    words = docs[0][1].split()
    near = [(10**6 + n, " ".join(words[: 60 + n] + [f"w{n}"])) for n in range(40)] + [(2 * 10**6 + n, docs[3][1]) for n in range(30)]
    rows = docs + near
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingle_set(t, k)) for i, t in rows}


def test_near_duplicates_of_odd_rows(odd, empty):
    found = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[10].component_id == 9 and not by[10].kept
    assert by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (5, 6, 7)) and by[8].n_shingles == 1
    assert minhash.near_duplicates(empty, 3, 85).count() == 0


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_a_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)
    base = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(1)
    rows = []
    for n in range(120):
        words = list(base)
        for i in rng.choice(120, 1 + n % 6, replace=False):
            words[i] = f"v{n % 40}x{i}"
        rows.append((n, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    brute = classes(rows, 3, 85)
    assert 5 < len(set(brute.values())) < 100
    assert {r.doc_id: r.component_id for r in found} == brute


def test_a_group_of_near_copies_gives_few_links():
    """The rows that leave the comparison follow the components, not the pairs."""
    import pyarrow as pa

    rows, bands = minhash.layout(85)
    rng = np.random.default_rng(3)
    texts = []
    for n in range(300):
        words = [f"w{i}" for i in range(200)]
        for i in rng.choice(200, 7, replace=False):
            words[i] = f"v{n}"
        texts.append(" ".join(words))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["d", "t"])
    made = pa.Table.from_batches(minhash._signatures(3, rows, bands)([batch])).combine_chunks()
    sets = pa.Table.from_batches(minhash._sets(3, None)([batch])).combine_chunks()
    ids = made.column("doc_id")
    got = minhash._compare((0, 0, 0, 0), [pa.RecordBatch.from_arrays(
        [ids.combine_chunks(), ids.combine_chunks(), made.column("n_shingles").combine_chunks(), pa.array([True] * 300), pa.array([True] * 300), pa.array([True] * 300), made.column("signature").combine_chunks(), made.column("bands").combine_chunks(), sets.column("shingles").combine_chunks()],
        names=["rep", "comp", "n", "stray", "as_stray", "as_member", "signature", "bands", "shingles"])], 85)
    assert got.num_rows < 300


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_near_the_threshold(percent):
    """Pairs whose similarity is at most two points above the threshold, and how many share a band and pass the signatures."""
    import pyarrow as pa

    rows, bands = minhash.layout(percent)
    rng = np.random.default_rng(5)
    texts, pairs = [], 0
    while pairs < 400:
        n, s = int(rng.integers(60, 400)), percent / 100 + 0.01
        a = [f"w{x}" for x in rng.integers(10**6, size=n).tolist()]
        b = list(a)
        for i in rng.choice(n, max(1, round(n * (1 - s) / (1 + s) / 3)), replace=False):
            b[i] = f"x{rng.integers(10**6)}"
        x, y = shingle_set(" ".join(a), 3), shingle_set(" ".join(b), 3)
        if percent <= 100 * len(x & y) / len(x | y) <= percent + 2:
            texts += [" ".join(a), " ".join(b)]
            pairs += 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["d", "t"])
    made = pa.Table.from_batches(minhash._signatures(3, rows, bands)([batch]))
    keys = np.array(made.column("bands").to_pylist())
    sig = np.stack([np.frombuffer(x, np.uint8) for x in made.column("signature").to_pylist()])
    share = (keys[::2] == keys[1::2]).mean(1)
    assert (share > 0).all()
    # bands agree as often as independent minima would
    assert abs(share.mean() - ((percent + 1) / 100) ** rows) < 0.05
    assert (minhash._similar(sig[::2], sig[1::2]) >= minhash.lowest_estimate(percent, sig.shape[1])).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9)], "a long, b long")
    found = {r.node: r.comp for r in minhash.components(links).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}


def test_bands_miss_less_than_promised():
    for percent in (80, 85):
        rows, bands = minhash.layout(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-8 and rows * bands <= 256


# -- decontamination ---------------------------------------------------------


def test_contaminated_is_exact(spark, small, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, "short item"), (901, None), (902, "one two three four five six seven"), (903, docs[1][1])]
    rows = docs + [(10**6, "so a short item"), (10**6 + 1, "short item"), (10**6 + 2, "zero one two three four five six eight " * 50), (10**6 + 3, None), (10**6 + 4, "x " * 4000 + items[0][1])]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = {}
    for i, t in rows:
        a = shingle_set(t, 5)
        for j, u in items:
            b = shingle_set(u, 5)
            if b and len(a & b) >= 0.8 * len(b):
                expected[i, j] = len(a & b) / len(b)
    assert {(r.doc_id, r.item_id): r.containment for r in found} == expected


def test_items_in_several_blocks(spark, small, docs, monkeypatch):
    table, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(decontaminate.contaminated(table, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 40)
    assert sorted(decontaminate.contaminated(table, items).collect()) == whole


def test_decontaminate_keeps_columns_and_clean_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (None, "word")], "item_id long, text string")
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 6, 7, 8, 11, 12, 13]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


# -- tokens ------------------------------------------------------------------


@pytest.mark.parametrize(("name", "leads"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(docs, name, leads):
    texts = [t for _, t in docs] + [t for _, t in ODD] + ["a  b", " a", "a ", "\n a", "x\ny", "a\n\nb", "don't 've it's.", "ÀÉ ̈x", "a　k", "3.5,a 4;b", "…. …a ÷.× é.è!", " ", "<|endoftext|>"]
    got = Encoder(name, leads).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library_ids(name, text, 0)[:-1], text


def test_variable_length_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, codes = token_files.encode(ranks)
        assert len(control) == -(-n // 4) and (token_files.decode(control, codes, n) == ranks).all()
    with pytest.raises(ValueError):
        token_files.decode(b"\0", b"\1\2", 1)


def test_ranks_follow_frequency():
    assert token_files.rank_table(np.array([3, 9, 0, 9])).tolist() == [1, 3, 0, 2]


def test_token_files(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    rows = docs + [(i and i + 10**6, t) for i, t in ODD]
    path = new_path(spark, "test")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, ranges=5)
    found = token_files.read(spark, path).orderBy("start").collect()
    expected = sorted(((i, library_ids("byte_bpe_50k.json", t, 0)) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found] == expected
    assert [r.start for r in found] == [0, *np.cumsum([len(x) for _, x in expected])[:-1].tolist()] and all(r.n_tokens * 4 == len(r.ids) for r in found)
    path = new_path(spark, "test")
    token_files.write(empty, path)
    assert token_files.read(spark, path).count() == 0


def test_packing(spark, docs, empty):
    rows = docs + ODD
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in found)
    pieces = Counter((r.doc_id, r.start, r.ids) for r in found)
    expected = Counter()
    for i, t in rows:
        ids, at = library_ids("word_bpe_49k.json", t, 2), 0
        for n in packing.cuts(len(ids)):
            expected[i, at, np.array(ids[at : at + n], "<u4").tobytes()] += 1
            at += n
        assert at == len(ids)
    assert {(i, s, bytes(b)): n for (i, s, b), n in pieces.items()} == expected
    assert packing.pack(empty).count() == 0
    assert packing.cuts(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.cuts(0) == []


def test_pieces_leave_in_buckets_of_equal_length(spark, docs):
    table = spark.createDataFrame(docs + ODD, "doc_id long, text string").repartition(3)
    found = packing.pack(table).withColumn("task", F.spark_partition_id()).collect()
    for task in range(3):
        rows = [(r.seq_len, r.sequence_id) for r in found if r.task == task]
        assert [n for n, _ in rows] == sorted((n for n, _ in rows), reverse=True) and len({n for n, _ in rows}) > 5
        for size in {n for n, _ in rows}:
            ids = [i for n, i in rows if n == size]
            assert ids == list(range(ids[0], ids[0] + len(ids)))
    assert len({r.sequence_id for r in found}) == len(found)


# -- fingerprints ------------------------------------------------------------


def test_fingerprints(spark, docs):
    rows = docs + [(i + 10**6, t) for i, t in ODD if i is not None]
    found = merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ranges=6).collect()
    ordered = sorted(((i, t or "") for i, t in rows))
    got = sorted((r.doc_id, r.text, r.edited_text, r.fingerprint, r.near_edited) for r in found)
    expected = []
    for n, (i, t) in enumerate(ordered):
        changed = merkle.edited(t, ordered[(n + 1) % len(ordered)][1])
        expected.append((i, t, changed, merkle.fingerprint(t), merkle.likeness(merkle.fingerprint(t), merkle.fingerprint(changed))))
    assert got == sorted(expected)
    for r in found:
        assert (r.fingerprint == r.edited_fingerprint) == (r.text == r.edited_text)
        assert r.text == r.edited_text or r.near_next == 1.0 or r.near_edited >= r.near_next


def test_tree_and_differing_branches():
    text = "Title one.\nFirst line here. And more of it!\n\nSecond section. " + "long " * 60 + "\nend"
    assert "".join(merkle.pieces(text)) == text and merkle.tree(text).digest.hex() == merkle.fingerprint(text)[:64]
    changed = text.replace("more", "less")
    spans = merkle.differing(merkle.tree(text), merkle.tree(changed))
    assert spans and all(a <= text.index("more") + 4 and text.index("more") <= b for a, b in spans)
    assert merkle.differing(merkle.tree(text), merkle.tree(text)) == [] and merkle.tree(None).children == []


def test_likeness_is_that_of_the_trees():
    """Against sections, paragraphs and pieces taken from the trees themselves."""

    def texts(node, text):
        return tuple(texts(c, text) for c in node.children) if node.children else text[node.start : node.end]

    def size(x):
        return len(x) if isinstance(x, str) else sum(map(size, x))

    def brute(a, b):
        if a == b:
            return 1.0
        levels, common = [list(texts(merkle.tree(t), t)) for t in (a, b)], 0
        for _ in range(3):
            same = Counter(levels[0]) & Counter(levels[1])
            common += sum(size(x) * n for x, n in same.items())
            levels = [[y for x, n in (Counter(side) - same).items() for _ in range(n) for y in (x if isinstance(x, tuple) else ())] for side in levels]
        return 2 * common / (len(a) + len(b)) if a or b else 0.0

    rng = np.random.default_rng(2)
    words = ["one", "two.", "three", "\n", "\n\n", "four!", "five ", "six " * 20, "\n" * 300, "x" * 400]
    made = [" ".join(words[i] for i in rng.integers(len(words), size=rng.integers(0, 40))) for _ in range(60)] + ["", "thin", "nhit"]
    for a in made:
        for b in made[:20] + made[-3:]:
            got = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
            assert got == pytest.approx(brute(a, b)) and (got == 1.0) == (a == b or got == 1.0)
    print_ = merkle.fingerprint
    assert merkle.likeness(print_("thin"), print_("nhit")) == 0.0
    assert merkle.likeness(print_("The quick fox jumps over it."), print_("Nobody knew where he went, the fool.")) < 0.2


@pytest.mark.parametrize("stops", [False, True])
@pytest.mark.parametrize("alphabet", ["abcdefghijklmnoprstu", "äöüßéèñçøåabcdefgh", "абвгдежзиклмнопрстуф", "的一是不了人我在有他这为之大来以个中上们"])
def test_a_word_put_in_changes_what_is_near_it(alphabet, stops):
    """A paragraph of 10,000 characters keeps its likeness wherever a word is put in or taken out; other paragraphs have none."""
    rng = np.random.default_rng(len(alphabet) + stops)

    def paragraph(blank=" "):
        out = []
        while sum(map(len, out)) + len(out) < 10_000:
            out.append("".join(rng.choice(list(alphabet), rng.integers(2, 10))) + ("." if stops and rng.random() < 0.1 else ""))
        return out, blank

    for blank in (" ", ""):
        words, _ = paragraph(blank)
        text, other = blank.join(words), blank.join(paragraph(blank)[0])
        own = merkle.fingerprint(text)
        for at in (0, 1, len(words) // 2, len(words)):
            assert merkle.likeness(own, merkle.fingerprint(blank.join([*words[:at], "inserted", *words[at:]]))) > 0.99
            assert merkle.likeness(own, merkle.fingerprint(blank.join(words[:at] + words[at + 1 :]))) > 0.99
        assert merkle.likeness(own, merkle.fingerprint(other)) < 0.1
        cut = text[: len(text) * 3 // 4] + other[: len(text) // 4]
        assert abs(merkle.likeness(own, merkle.fingerprint(cut)) - 0.75) < 0.05
    for run in ("a" * 10_000, "ab" * 5_000, "\n" * 10_000, "\ud800" * 3000):
        assert merkle.likeness(merkle.fingerprint(run), merkle.fingerprint("word " + run)) > 0.8 and max(map(len, merkle.pieces(run))) <= merkle.MOST


def test_long_texts_are_hashed_in_portions(docs, monkeypatch):
    texts = [t for _, t in docs[:40]] + ["", "ab", "x" * 3000]
    whole = [merkle.fingerprint(t) for t in texts]
    for portion in (3, 5, 300):
        monkeypatch.setattr(merkle, "PORTION", portion)
        assert [merkle.fingerprint(t) for t in texts] == whole


def test_clashing_columns(spark, odd):
    """Columns named as those that operators use inside change nothing."""
    plain = odd.select("doc_id", "text").where("doc_id is not null")
    other = plain.select("*", *[F.lit(c).alias(c) for c in ("d", "t", "bucket", "after", "ids", "n", "start", "place", "ranks")])
    for make in (lambda x: merkle.fingerprints(x).select("doc_id", "fingerprint", "near_next"), lambda x: packing.pack(x).select("doc_id", "start", "length", "ids")):
        assert sorted(map(tuple, make(other).collect())) == sorted(map(tuple, make(plain).collect()))
    path = new_path(spark, "files")
    token_files.write(other, path)
    assert token_files.read(spark, path).count() == plain.count()


def test_fingerprints_of_few_rows(spark, empty):
    one = merkle.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert [r.edited_text for r in one] == ["abcdefab"]
    assert merkle.fingerprints(empty).count() == 0
    nulls = merkle.fingerprints(spark.createDataFrame([(None, "abcdefgh"), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.edited_text) for r in nulls) == [(0, "abcdef"), (1, ""), (1, "")]


# -- personal data -----------------------------------------------------------

_BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    out = []
    for kind, form in enumerate(_BASE):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_are_those_of_the_patterns(docs):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("a1.@-+ (4%5_"), 60)) for _ in range(3000)]
    made += ["1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1.2.3", "x@y@z.com a@b.c.@d.e", "+1 (626) 555-5759 4111 1111 1111 1111", "4111111111111111", "+" + "1" * 9, "é@b.co 1.1.1.1é"]
    for text in made + [t for _, t in docs]:
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_stay_linear():
    for text in ("a" * 300000, "1" * 300000, "1." * 150000, "@" * 300000, "+1" * 150000, "1 " * 150000):
        pii.base_spans(text)
        pii.detect([text], *pii.model())


@pytest.mark.parametrize("place", range(4))
def test_numbers_of_any_length_are_no_crash(place):
    """Zeros in front of a part change nothing, and a part of thousands of digits is only too large."""
    for part, good in (("0" * 5000, True), ("0" * 5000 + "255", True), ("0" * 5000 + "256", False), ("9" * 5000, False), ("00", True), ("255", True), ("300", False)):
        parts = ["1"] * 4
        parts[place] = part
        text = "x " + ".".join(parts) + " y"
        assert [s for s in pii.base_spans(text) if s[0] == 1] == ([(1, 2, len(text) - 2)] if good else [])
        pii.detect([text], *pii.model())


@pytest.mark.parametrize("size", [1, 63, 64, 65, 66, 1000, 100_000])
def test_spelled_addresses_of_any_length(size):
    """The whole local part and domain are proposed, and redacted whole if at all."""
    for text, span in ((f"mail {'a' * size} at example.com now", (5, 5 + size + 15)), (f"({'b.' * size}c[at]{'d' * size}.org)", (1, 3 * size + 10)), (f"{'x' * size}@site dot net", (0, size + 13))):
        assert (0, *span) in pii.candidates(text, False), text[:80]
        (_, found), = pii.detect([text], *pii.model())
        assert not found or found == [(0, *span)]


def test_the_method_adds_what_base_patterns_miss(spark, odd, empty):
    both = pii.detect([ODD[9][1]], *pii.model())[0]
    assert both[0] == [] and [s[0] for s in both[1]] == [3, 2]
    found = {r.doc_id: r for r in pii.find(odd).collect()}
    assert found[13].spans.startswith("phone:0:17,card:18:34") and found[8].spans == "" and pii.find(empty).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[13].text == "<PHONE> <CARD> Ärger" and rows[13].n_chars == 20 and rows[5].text is None and rows[8].n_chars == 1


def test_the_trees_hold_their_precision():
    import random

    fitted, least = pii.model()
    rng = random.Random(99)
    drawn = [pii._generated(rng, k) for _ in range(800) for k in range(4)]
    p = fitted.probability(np.array([pii.features(t, s) for t, s, _ in drawn], float))
    y, taken = np.array([g for _, _, g in drawn]), p >= np.array([least[s[0]] for _, s, _ in drawn])
    assert y[taken].mean() > 0.96 and taken[y == 1].mean() > 0.6


@pytest.mark.parametrize(("text", "kind"), [
    ("Please write to jane.doe at example.com soon", 0), ("mail me: JANE AT EXAMPLE DOT COM", 0), ("contact bob (at) site (dot) org", 0),
    ("login from fe80::1a2b:3c4d today", 1), ("client 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", 1),
    ("paid by card 4111-1111-1111-1111 yesterday", 2), ("call 314.555.6532 now", 3), ("phone: 314-555-6532", 3), ("tel. 314 555 6532", 3), ("fax 0712 4455 667", 3),
])
def test_forms_that_no_training_text_has(text, kind):
    (_, all_), = pii.detect([text], *pii.model())
    assert kind in [k for k, _, _ in all_]


_FORMS = {
    0: ("Please write to jane.doe at example.com soon", "mail me: JANE AT EXAMPLE DOT COM", "contact bob (at) site (dot) org", "reach us at info[at]company.net", "e-mail anna_smith [at] uni [dot] edu today", "send it to max.muster(at)firma.de bitte", "my address is carl@firm dot io", "contact: lee at mail dot co.uk", "write sales[at]shop[dot]com for a quote", "mail to first.last at sub.domain.org", "jose.garcia (at) correo.es", "kontakt: petra at beispiel dot de"),
    1: ("login from fe80::1a2b:3c4d today", "client 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", "host 2001:db8::ff00:42:8329 answered", "from 2001:db8:1:2:3:4:5:6 at noon", "ip fe80::abcd:1234:5678:9abc", "server 2607:f8b0:4005:805::200e", "::ffff:c0a8:0101 connected", "peer 2a00:1450:4001:81b::200e"),
    2: ("paid by card 4111.1111.1111.1111 yesterday", "visa 4111111111111111 on file", "amex 3782 822463 10005 expires", "card no 5500-0000-0000-0004", "mastercard 5555555555554444 charged", "my card 4012 8888 8888 1881 was lost", "credit card: 6011000990139424", "charged 378282246310005 today", "4111-1111-1111-1111"),
    3: ("call 314.555.6532 now", "phone: 314-555-6532", "tel. 314 555 6532", "fax 0712 4455 667", "mobile 0049 171 2345678", "call (314) 555-6532 today", "reach me on +44 20 7946 0958", "tel +49 30 1234567", "phone 0171 2345678", "call 0033 612 345 678", "fax: (030) 1234-5678", "mobile: +1-202-555-0143", "telephone 020 7946 0958"),
}


@pytest.mark.parametrize("kind", range(4))
def test_recall_of_forms_written_by_hand(kind):
    found = [kind in [k for k, _, _ in pii.detect([text], *pii.model())[0][1]] for text in _FORMS[kind]]
    assert sum(found) >= 0.9 * len(found)


@pytest.mark.parametrize("text", ["order 314-555-6532", "invoice 0712 4455 667", "we met at noon. Then we left", "version 12:30:45:10", "it was 10:30:20 by then", "serial no. 4111111111111112"])
def test_look_alikes_are_left_alone(text):
    assert pii.detect([text], *pii.model())[0][1] == []


@pytest.mark.parametrize("part", ["a@b.co ", "a at b dot com ", "4111111111111111 ", "+1 (314) 555-6532 ", "1.", "a", "1 ", "1:", "a@", "at ", "(", "+1", "::1 ", "0", "1.1.1.0", " at ", "a at ", " at a.b", "[at]", "x[at]y.zz", "x at y dot ", "@ dot ", "a@b dot "])
def test_a_hostile_text_is_searched_in_linear_time(part):
    import time

    began = time.process_time()
    pii.detect([part * (500_000 // len(part))], *pii.model())
    assert time.process_time() - began < 20


# -- licenses ----------------------------------------------------------------


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({label for _, label in places}))


def test_license_base_is_exact(spark, docs, odd, empty):
    made = ["under the MIT License under the mit license", "CC BY-NC cc by nc by nc cc by nc", "Apache License, Version 2.0 under.the/mit license", "the MIT licenses", "É under the mit licenseé", "Licensed under CC BY-NC-SA 4.0", "licensed under the apache license version 2"]
    rows = docs + ODD + [(100 + i, t) for i, t in enumerate(made)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = Counter((i, *plain_scan(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == expected
    by = {r.doc_id: r for r in found}
    assert by[105].labels == "cc-by-nc,cc-by-nc-sa" and by[8].labels == "" and by[8].score == 0.0
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == len(ODD)


def test_license_rules_and_suppression(spark):
    rows = [(1, "Released under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "a permit to omit"), (5, "All rights reserved.")]
    by = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [by[i].labels for i in range(1, 6)] == ["mit", "gpl-3", "cc-by-nc", "", "proprietary"]
    assert len(licenses.rules()) > 200
    for d in by[2].detections:
        assert not any(o is not d and o.start <= d.start and o.end >= d.end and o.priority > d.priority for o in by[2].detections)


RULES = [(label, word, re.compile(form), priority, strength) for label, word, form, priority, strength in licenses.rules()]


def scanned(text):
    """Detections by the definition: all rules over the whole text, all pairs for suppression. On long texts the keywords tell what need not be tried."""
    words = " " + re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", text or "").strip(" ") + " "
    low = words.translate(_LOW)
    found = [(label, priority, strength, *m.span()) for label, word, form, priority, strength in RULES if len(low) < 600 or word[0] in low and word[1] in low for m in form.finditer(low)]
    return sorted(d for d in found if not any(o[3] <= d[3] and o[4] >= d[4] and (o[1] > d[1] or o[1] == d[1] and o[4] - o[3] > d[4] - d[3]) for o in found))


def test_license_detections_are_those_of_all_rules_and_pairs(spark, docs):
    """On the small table, on a text for each rule, and on mixtures of these."""

    def sample(form, pick):
        form = re.sub(r"^\(\?<!\[\^ \]\)|\(\?!\[\^ \]\)$", "", form)
        while True:
            m = re.search(r"\((?:\?:)?([^()]*)\)([?*]?)", form)
            if not m:
                break
            form = form[: m.start()] + ("" if m[2] and pick % 2 else m[1].split("|")[pick % len(m[1].split("|"))]) + form[m.end() :]
        form = re.sub(r"\[\^? ?([^]])[^]]*\](\{\d+\})?\??", r"\1", form)
        form = re.sub(r"\.\{1,\d+\}\?", "some name", form)
        return re.sub(r"(.)\?", r"\1", form)

    assert licenses.ungated(licenses.rules()) == [] and len(license_rules.written()) > 200
    texts = [sample(form, n) for n, (_, _, form, _, _) in enumerate(licenses.rules())]
    hit = sum(bool(scanned(t)) for t in texts)
    assert hit > 0.95 * len(texts)
    rng = np.random.default_rng(4)
    mixed = [", ".join(texts[i].title() for i in rng.integers(len(texts), size=12)) for _ in range(40)] + ["released under the MIT license. " * 30]
    rows = [(i, t) for i, (_, t) in enumerate(docs)] + [(10**6 + i, t) for i, t in enumerate(texts + mixed)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert sorted((d.label, d.priority, d.strength, d.start, d.end) for d in r.detections) == scanned(t), t
        base = {label for phrase, label in licenses.PHRASES.items() if phrase in t.translate(_LOW)} if t else set()
        assert set(filter(None, r.labels.split(","))) >= {x[0] for x in scanned(t)} and (base <= set(r.labels.split(",")) or not base)


def test_many_licenses_in_one_text(spark):
    import time

    rows = spark.createDataFrame([(n, "released under the MIT License. " * 2000) for n in range(2)], "doc_id long, text string")
    licenses.scan(rows.where("doc_id < 0")).collect()
    began = time.time()
    assert [r.n_base for r in licenses.scan(rows).collect()] == [2000, 2000]
    assert time.time() - began < 30


def test_license_scan_is_native(spark, docs):
    plan = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- chat --------------------------------------------------------------------


def test_escapes_are_reversible():
    rng = np.random.default_rng(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", " ", "<\\s>", "[\\\\INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 8)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(m in made for m in chat.MARKS)


def plain_digests(turns):
    rows = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark, small):
    found = {r.conv_id: r for r in queries.op7_chat(spark, small).collect()}
    turns = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == {c: plain_digests(t) for c, t in turns.items()}


def test_chat_of_odd_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 3)
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 64)
    rows = [(1, None, None, None, "s"), (1, 0, "user", "", "s"), (1, 0, "user", "", "s"), (1, 0, "assistant", "é <s> \\", "s"), (1, 500, "assistant", " lead and trail ", "s"), (1, 501, "tool]", "[INST]", "s"), (None, 1, "assistant", "x", "s")] + [(2, 7, "assistant", f"t{i} ", "s") for i in range(10)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, s string")
    formatted = chat.format_chat(table)
    dealt = formatted.repartition(1).sortWithinPartitions("conv_id", "segment", "part")
    found = {r.conv_id: r for r in dealt.mapInArrow(queries._chat_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    turns = {}
    for c, n, r, t, _ in rows:
        turns.setdefault(c, []).append((n, r, t))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == {c: plain_digests(t) for c, t in turns.items()}
    assert chat.format_chat(table.limit(0)).count() == 0


def test_whole_and_parts_have_the_same_ids(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} <s>, é") for i in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chat(table).count() == 1  # rendered and encoded whole
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 64)
    parts = chat.format_chat(table).orderBy("segment", "part").collect()
    text, spans = chat.render([(r, t) for _, _, r, t in rows])
    whole = chat._tokenizer(chat.TOKENIZER).encode(text, add_special_tokens=False)
    assert len(parts) == 4 and [i for p in parts for i in p.token_ids] == whole.ids and "".join(p.formatted for p in parts) == text
    assert [m for p in parts for m in p.loss_mask] == chat.token_mask(np.array(whole.offsets), [(a, b) for a, b, r in spans if r == "assistant"]).tolist()


# -- toxicity ----------------------------------------------------------------


def test_disguised_words_are_restored(spark, small):
    model = toxicity.char_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for disguised in ("1d10t", "i d i o t", "idiooot", "m0r0n", "$cum", "tr@sh", "l.o.s.e.r"):
        assert model.restore(f"the {disguised} is") == f"the {'idiot' if disguised[0] == 'i' or disguised[0] == '1' else {'m': 'moron', '$': 'scum', 't': 'trash', 'l': 'loser'}[disguised[0]]} is"
    for plain in ("2024 was", "see 173.33.203.46 now", "A short note.", "Élan tell egg"):
        assert model.restore(plain) == plain


def test_disguises_of_any_length_are_restored(spark):
    model = toxicity.char_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert model.restore("the st" + "u" * 17 + "pid one") == "the stupid one"
    assert model.restore("the 1d" + "1" * 5000 + "0t one") == "the idiot one"
    long = "incomprehensibilities"
    for sep in " .-":
        assert model.restore(f"an {sep.join(long)}, no") == f"an {long}, no"
    mixed = "l0s3r" * 4000  # no runs to collapse
    found = model.restore(f"{mixed} and {' '.join(mixed)}").split(" and ")
    assert found[0] == "loser" * 4000 and found[1] == " ".join(["loser"] * 4000)  # spelled out, words are parted


def test_viterbi_is_the_best_of_all_readings():
    import itertools

    rng = np.random.default_rng(6)
    model = toxicity.CharModel.of(rng.integers(0, 50, 28**3))
    signs = "abcst0134578@$!|+9"
    for _ in range(300):
        low = "".join(signs[i] * int(rng.integers(1, 4)) for i in rng.integers(len(signs), size=rng.integers(1, 6)))
        ways = [("".join(x for x, _ in way), model.cost([x for x, _ in way], [c for _, c in way])) for way in itertools.product(*model.lattice(low))]
        value, got = model.read(model.lattice(low))
        assert value == pytest.approx(max(v for _, v in ways)) == pytest.approx(max(v for x, v in ways if x == got))
        if any(c.isalpha() for c in low) and not low.isalpha() and "9" not in low:
            every = [*ways, (low, model.cost(*model.literal(low)))]
            assert max(v for x, v in every if x == model.token(low)) == pytest.approx(max(v for _, v in every))


def test_words_end_where_the_best_of_all_readings_ends_them():
    """Spelled-out words against every way to part them and every letter that a sign may be."""
    import itertools

    rng = np.random.default_rng(16)
    model = toxicity.CharModel.of(rng.integers(0, 50, 28**3))
    signs = "abcst01369@$*(а"
    for _ in range(200):
        word = "".join(signs[i] for i in rng.integers(len(signs), size=rng.integers(3, 6)))
        options = model.apart(word)
        ways = [("".join(x for x, _ in way), model.cost([x for x, _ in way], [c for _, c in way])) for way in itertools.product(*options)]
        value, got = model.read(options)
        assert value == pytest.approx(max(v for _, v in ways), abs=1e-4) == pytest.approx(max(v for x, v in ways if x == got), abs=1e-4)


def test_spelled_words_signs_and_other_scripts(spark):
    model = toxicity.char_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for disguised, word in (("s t u p i d i d i o t", "stupid idiot"), ("p a t h e t i c l o s e r", "pathetic loser"), ("w-o-r-t-h-l-e-s-s-c-l-o-w-n", "worthless clown"), ("y o u s t u p i d i d i o t", "you stupid idiot"), ("I.d.i.o.t", "Idiot"), ("s t u p 1 d i d i 0 t", "stupid idiot"), ("s t u u u p i d", "stupid")):
        assert model.restore(f"the {disguised}, so") == f"the {word}, so"
    for disguised, word in (("stuрid", "stupid"), ("іdіоt", "idiot"), ("m*ron", "moron"), ("s(um", "scum"), ("paтheтic", "pathetic"), ("tra5h", "trash")):
        assert model.restore(f"the {disguised} so") == f"the {word} so"
    for plain in ("привет мир", "Καλημέρα κόσμε", "**bold** text", "(see note)", "a (b) c", "2nd 6th 9pm", "word* and more"):
        assert model.restore(plain) == plain
    for text in ("о" * 3000 + "a", "a о" * 3000, "s t u p i d " * 2000, "a*" * 5000, "(a" * 5000, "a" + "*" * 5000 + "b"):
        model.restore(text)  # odd texts of any length end


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_numbers_with_letters_stay_as_they_are(spark, sf):
    model = toxicity.char_model(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
    for token in ("4th", "3rd", "mp3", "4pm", "1st", "Wow!", "8th", "10th"):
        assert model.token(token) == token


def test_held_out_documents_are_told_apart(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.char_model(rows)
    scored = toxicity.score(rows, model, toxicity.train(rows, labels, model)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    y, p = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    order = np.argsort(np.argsort(p))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert len(y) > 500 and auc > 0.95 and y[p >= 0.3].mean() > 0.85 and 0 <= p.min() and p.max() <= 1


def test_toxicity_of_odd_rows(spark, odd, empty):
    model = toxicity.char_model(odd)
    scorer = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"), model)
    assert toxicity.score(odd, model, scorer).count() == len(ODD) and toxicity.score(empty, model, scorer).count() == 0
    kept = toxicity.without_toxic(odd, model, scorer, cut=0.9)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert toxicity.char_model(empty).logs.shape == (28,) * toxicity.ORDER


# -- pages -------------------------------------------------------------------


def test_articles_are_extracted(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r.page_id: r for r in style_tree.extract(pages).collect()}
    import html

    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[p.page_id].text.split("\n") == [b for b in blocks if b] and found[p.page_id].n_chars == len(found[p.page_id].text)


def _page(title, body, i):
    return f"<html><body><div class=c1><div class=c2><p>Home page of the site with its many offers</p><p>Call us today for a free and friendly quote</p></div><div class=c3><h2>{title}</h2>{body}</div><div class=c4><p>We use small files to make this site work for you</p></div></div></body></html>"


def test_style_trees_find_noise_without_telling_names(spark):
    rows = [(i, f"http://h.example/{i}", _page(f"Title number {i}", "".join(f"<p>Sentence {i} {j} tells of {i * 7 + j} things and {j} more</p>" for j in range(3)), i)) for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in style_tree.extract(table).collect()}
    assert found[4] == "Title number 4\n" + "\n".join(f"Sentence 4 {j} tells of {28 + j} things and {j} more" for j in range(3))
    assert {r.page_id: r.text for r in style_tree.extract(table, sent_rows=0).collect()} == found


def test_all_runs_of_a_block_count(spark):
    import math

    stock = " ".join(f"stock{i}" for i in range(20))
    pages = [f"<body><div class=x><p>{stock} " + " ".join(f"w{i}x{j}" for j in range(60)) + "</p></div><p>short One</p></body>" for i in range(30)]
    table = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.path: (r.site, r.all) for r in style_tree.importances(table).collect()}
    runs: dict[int, Counter] = {}
    for p in pages:
        for b in style_tree.parse(p)[0]:
            w = b.text.split()
            runs.setdefault(b.path, Counter()).update({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))})
    assert len(runs) == 2 and found.keys() == runs.keys()
    for path, n in runs.items():  # every page has the same children, so only content counts
        content = 1 - sum(k * math.log(k) for k in n.values()) / sum(n.values()) / math.log(30)
        assert found[path] == pytest.approx((0.9 * content, 0.9 * content))


def test_counts_do_not_depend_on_how_they_are_sent(monkeypatch):
    import pyarrow as pa

    rows = [(f"http://{i % 3}.example/", f"<div><p>a b c d e {i % 5} f g</p><p>x y {i}</p></div>") for i in range(40)]

    def counted(size):
        parts = [b for i in range(0, 40, size) for b in style_tree._observe(iter([pa.RecordBatch.from_pylist([{"url": u, "html": h} for u, h in rows[i : i + size]])]))]
        one = pa.Table.from_batches(parts).sort_by("group").combine_chunks().to_batches()
        total: Counter = Counter()
        for r in pa.Table.from_batches(style_tree._counted(iter(one))).to_pylist():
            total.update({(r["host"], r["path"], r["what"], k): r[k] for k in ("n", "nlog")})
        return total

    whole = counted(40)
    assert whole == pytest.approx(counted(7))
    monkeypatch.setattr(style_tree, "HELD", 1)
    monkeypatch.setattr(style_tree, "HELD_SUMS", 2)
    assert whole == pytest.approx(counted(7))


def test_odd_pages(spark):
    shapes = [None, "", "plain text only &amp; more", "<p>unclosed <b>bold<br>line<p>next", "<article><p>A<script>x='</p>'</script> b</p><div class='comments'><p>reader</p></div></article><footer>f</footer>", "<ul><li>one<li>two</ul>", "<!-- <p>no</p> --><p>yes &lt;tag&gt; &eacute;</p>", "<p a=\"x>y\">q</p><", "<main><form><p>f</p></form><p>m</p></main>", "<p>" * 3000 + "deep"]
    rows = [(i, None if i % 2 else "http://a.b/c", h, "z") for i, h in enumerate(shapes)] + [(3, "x", shapes[3], "z")]
    found = [(r.page_id, r.text) for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    assert len(found) == len(rows)
    by = dict(found)
    assert by[0] == by[1] == "" and by[2] == "plain text only & more" and by[3] == "unclosed bold line\nnext" and by[4] == "A b" and by[5] == "one\ntwo" and by[6] == "yes <tag> é" and by[8] == "m" and by[9] == "deep"
    assert style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>Hello <button>x</p><p>rest</article>", "Hello\nrest"),
    ("<article><p>a <button>x</button> b<select><option>1</select> c</p></article>", "a b c"),
    ("<article><div class=comment-policy-story>one</div><p class='side-effects'>two</p><div class='comment-list'>no</div><div id=shareBar>no</div></article>", "one\ntwo"),
    ("<p>a<svg><title>t</title><text>no</text></svg>b</p>", "a b"),
    ("<p>x <a href='>'>y</a> <b title=\"it's\">z</b></p>", "x y z"),
    ("<p>1 < 2 and <3 <a href=\"u>v", "1 < 2 and <3 v"),
    ("<div>a<script>b", "a"), ("</p></div>a</span>b", "ab"), ("<button><div>no</div></button><p>yes", "yes"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
])
def test_page_shapes(page, text):
    assert style_tree.main_text(page, {}) == text


@pytest.mark.parametrize("part", ["<a<a", "<div></p>", "<a '", "<a \">\"", "<!-- ", "</script", "<script>", "<svg>", "<dd><blockquote>", "<p a" + "b" * 50 + " ", "<button><div>", "&amp", "<p class='" + "x" * 40, "a=\"", "<![", "</", "<li><div>"])
def test_a_hostile_page_takes_linear_time(part):
    import time

    began = time.process_time()
    style_tree.parse(part * (1_000_000 // len(part)))
    style_tree.parse("<p " + part.strip("<") * (1_000_000 // len(part)) + ">x")
    assert time.process_time() - began < 20


# -- shared ------------------------------------------------------------------


def test_temporary_tables_go_and_others_stay(spark):
    import os

    one = shared.materialize(spark.range(3), "one")
    with shared.temporary(spark):
        path = shared.new_path(spark, "two")
        spark.range(4).write.parquet(path)
        assert spark.read.parquet(path).count() == 4
    assert not os.path.exists(path.removeprefix("file://")) and one.count() == 3


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "spark://there:7077", "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
    Context.master = "local[2]"
    assert shared.shared_dir(Session()).startswith("file:///")


# -- the registered queries --------------------------------------------------


def _rows(spark, small, name, key="doc_id"):
    found = queries.QUERIES[name](spark, small)
    return found.columns, {r[key]: r for r in found.collect()}


def test_query_of_pages(spark, small):
    columns, found = _rows(spark, small, "op1_html_extraction", "page_id")
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()}
    assert columns[:4] == ["page_id", "url", "text", "n_chars"] and {i: r.url for i, r in found.items()} == pages
    assert all(r.n_chars == len(r.text) and "\n\n" not in r.text and r.text == r.text.strip() for r in found.values())


def test_query_of_toxicity(spark, small, docs):
    columns, found = _rows(spark, small, "op2_toxicity")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and found.keys() == {i for i, _ in docs}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_query_of_fingerprints(spark, small, docs):
    columns, found = _rows(spark, small, "op3_fingerprints")
    assert columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ordered = sorted(docs)
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + after[:cut]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert found[i].edited_fingerprint == merkle.fingerprint(changed) and 0 <= found[i].near_next <= 1
    assert np.mean([r.near_edited - r.near_next for r in found.values()]) > 0.4


def test_query_of_token_files(spark, small, docs):
    columns, found = _rows(spark, small, "op4_token_output")
    assert columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at = 0
    for i, t in sorted(docs):
        ids = library_ids("byte_bpe_50k.json", t, 0)
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_query_of_personal_data(spark, small, docs):
    columns, found = _rows(spark, small, "op5_pii")
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for i, t in docs:
        base = pii.base_spans(t or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert found[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(found[i].spans.split(","))
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == n for s in base) for n in range(4)]


def test_query_of_licenses(spark, small, docs):
    columns, found = _rows(spark, small, "op9_license")
    assert columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))
        places = [(n, label) for phrase, label in licenses.PHRASES.items() for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((n for n, _ in places), default=None), max((n for n, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted({x for _, x in places} | {d[0] for d in scanned(t)})) and 0 <= r.score <= 1


def test_query_of_packing(spark, small, docs):
    found = queries.QUERIES["op10_packing"](spark, small)
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces: dict[int, list] = {}
    rows = found.collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)
    for i, t in docs:
        ids, at = library_ids("word_bpe_49k.json", t, 2), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, small)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(expected.fetchall())


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>One.</p><section id='discussion'><p>We discuss.</p></section><section id=related><p>Work of others.</p></section></article>", "One.\nWe discuss.\nWork of others."),
    ("<main><h2 id='related'>Related work</h2><p id='discussion'>It was discussed.</p></main>", "Related work\nIt was discussed."),
    ("<body><p id='legal'>Legal status of X</p></body>", "Legal status of X"),
    ("<article><div class='header'><h1>Title</h1></div><p>Text.</p></article>", "Title\nText."),
    ("<article><p>Teaser.</p></article><div><p>" + "The story is told here. " * 5 + "</p></div>", "Teaser.\n" + " ".join(["The story is told here."] * 5)),
    ("<article><p>" + "The story is told here. " * 5 + "</p></article><div><p>Teaser.</p></div>", " ".join(["The story is told here."] * 5)),
    ("<p>Let <math><mi>x</mi></math> be even, <object>as drawn</object></p>", "Let x be even, as drawn"),
    ("<article><p>Text.</p><div class='comments'><p>First!</p></div><div id='comments'>No!</div><div class='ad'>Buy</div><aside>More</aside></article>", "Text."),
    ("<div id='sidebar'>Links</div><div class='notice'>Cookies</div><p>Text.</p>", "Text."),
])
def test_an_article_keeps_its_own_parts(page, text):
    """Anchors and names that may be topics decide nothing inside; containers that can only be noise go."""
    assert style_tree.main_text(page, {}) == text


@pytest.mark.parametrize("prompt", [20, 60])
def test_items_that_share_a_prompt(spark, prompt, monkeypatch):
    """Documents with the prompt alone are no candidates of its thousands of items; those with an item are found."""
    rng = np.random.default_rng(prompt)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    head = " ".join(word() for _ in range(prompt))
    items = [(i, f"{head} " + " ".join(word() for _ in range(int(rng.integers(8, 60))))) for i in range(4000)]
    items += [(4000 + i, head) for i in range(20)]  # nothing but the prompt
    docs = [(i, " ".join(word() for _ in range(50)) + f" {head} " + " ".join(word() for _ in range(50))) for i in range(60)]
    planted = {(100 + i, int(j)) for i, j in enumerate(rng.choice(4000, 40, replace=False))}
    docs += [(d, f"so {word()} {items[i][1]} {word()}") for d, i in planted]
    tried = []
    collect = decontaminate._collect
    monkeypatch.setattr(decontaminate, "_collect", lambda pairs, *rest: (collect(pairs, *rest), tried.append(len(pairs)))[0])
    block = decontaminate.Block([i for i, _ in items], [np.unique(decontaminate.distinct(*decontaminate.shingles(pa.array([t]), 5))[0]) for _, t in items], decontaminate.SHARE)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["d", "t"])
    found = [r for out in decontaminate._search(block, 5)(iter([batch])) for r in out.to_pylist()]
    sets = {i: shingle_set(t, 5) for i, t in items}
    want = set()
    for d, t in docs:
        own = shingle_set(t, 5)
        want |= {(d, i) for i, s in sets.items() if len(own & s) >= 0.8 * len(s) - 1e-9}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and want >= planted
    assert max(tried) < 2 * len(want) + 1000  # and not 400,000
