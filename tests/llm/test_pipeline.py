"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
from lithos.llm import pii, toxicity

from .test_text_operators import classes, shingle_set


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    model = toxicity.char_model(docs)
    scorer = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"), model)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model, scorer).collect()}
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def after(name, rows):
        if name == "toxicity":
            return [r for r in rows if score[r.doc_id] < toxicity.CUT]
        if name == "near duplicates":
            found = classes([(r.doc_id, r.text) for r in rows], 5, 80)
            return [r for r in rows if found[r.doc_id] == r.doc_id]
        if name == "benchmark decontamination":
            return [r for r in rows if not any(b and len(shingle_set(r.text, 5) & b) >= 0.8 * len(b) for b in items)]
        return rows

    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, small)
        assert made.columns == columns
        expected, rows = after(name, before), made.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in expected), name
        if name == "personal data":
            texts = {r.doc_id: r.text for r in expected}
            assert all(r.text == pii.redacted(texts[r.doc_id], pii.detect([texts[r.doc_id]], *pii.model())[0][1]) and r.n_chars == len(r.text) for r in rows)
            assert not any(pii.base_spans(r.text) for r in rows)
        else:
            assert len(rows) < len(before)
        docs, before = spark.createDataFrame(rows, made.schema), rows
    packed = corpus_pipeline.packing_stage(spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before}
    total = {r.doc_id: r.doc_tokens for r in packed}
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == total


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    one, two, near = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "other words that stand here once and nowhere else at all", "a b c d e f g h i j k l m n o p q r s t u v w x y z0"
    rows = [(3, one), (3, one), (None, one), (5, near), (3, two), (None, two), (None, "text of a null id that has no copy"), (None, ""), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert made.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in made.collect()), key=str)
    assert found == sorted([(3, one), (3, two), (None, rows[6][1]), (None, ""), (None, ""), (9, None)], key=str)


def test_run_is_the_stages_one_after_the_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    key = lambda r: (r.doc_id, r.start, r.length, bytes(r.ids))
    assert sorted(map(key, corpus_pipeline.run(spark, small).collect())) == sorted(map(key, docs.collect()))
    assert re.fullmatch(r"[a-z ]+", corpus_pipeline.STAGES[0][0])


def test_stages_of_odd_rows_and_of_none(spark, small):
    """Nulls, empty and blank texts, repeats, ties and columns with clashing names."""
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n", "en"), (4, "one two three four five six seven", "en"), (4, "one two three four five six seven", "en"), (None, "some other words that stand here alone", "en"), (5, "mail a@b.co " + "word " * 3000, None)]
    names = ["_row", "gone", "component_id", "t", "d", "place", "score"]
    table = spark.createDataFrame([(*r, "s", 1, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    kept = {name: corpus_pipeline.STAGES[n][1](spark, table, small) for n, (name, _) in enumerate(corpus_pipeline.STAGES)}
    for name, found in kept.items():
        if name != "packing":
            assert found.columns == table.columns
    texts = lambda name: sorted((r.text or "") for r in kept[name].collect())
    every = sorted((t or "") for _, t, _ in rows)
    assert len(texts("toxicity")) <= len(rows) and texts("benchmark decontamination") == every
    assert texts("near duplicates") == sorted([every[0], *every[1:3], *sorted(set(every[3:]))])
    assert sum(t.startswith("mail <EMAIL> ") for t in texts("personal data")) == 1 and len(texts("personal data")) == len(rows)
    pieces = kept["packing"].collect()
    assert sum(r.start == 0 for r in pieces) == len(rows) and {r.doc_tokens for r in pieces if r.doc_id in (1, 2, 3)} == {1}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), small).count() == 0
