"""Ranked lexical search over an index in shards of documents.

A shard holds some documents' postings as compressed rows: the hashes of its
terms, sorted, where each term's postings begin, and for every posting the
document's place and an integer impact, made once from the term's count and the
document's length. A search looks its terms up in every shard, adds weight
times impact term at a time to a dense array over the shard's documents, takes
the best by ``argpartition`` with ties settled by id, and merges over the
shards of a task and then over tasks.

Terms are known by 64-bit hashes that no linear family of texts can make
collide; among 10**10 terms of documents and 10**5 of queries two are confused
with a chance below 1e-4.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices, spans, text_bytes, word_hashes
from .shared import materialize

#: Bytes of text in a shard, unless a single text is longer.
SHARD_BYTES = 8 << 20
#: Most query terms, and queries, that go through the index at once.
BLOCK_TERMS, BLOCK_QUERIES = 1 << 18, 1 << 12
TOP = 10
#: Score constants in whole numbers: the scale of weights, of impacts, of counts, length's share of 100, and its factor.
WEIGHT, IMPACT, COUNT, SHARE, FACTOR = 1000, 1_000_000_000, 1000, 75, 8

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text, A-Z lower-cased, and each text's offsets among them; null has none."""
    return word_hashes(*text_bytes(texts), is_word=_TERM)


def weight(n_docs: int, df: int) -> int:
    """A term's weight, from doubles rounded down."""
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of counts ``tf`` in documents of ``n`` terms, in whole numbers."""
    scaled = n.astype(object) if SHARE * int(n.max(initial=0)) * n_docs >= 1 << 63 else n
    length = (100 - SHARE + (SHARE * scaled * n_docs) // n_terms).astype(np.int64)
    return (IMPACT * tf) // (COUNT * tf + FACTOR * length)


@dataclass
class Index:
    """``shards`` (doc_ids, n_docs, terms, starts, docs, impacts), the number of documents with a term, and of all terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = words = 0
    for batch in slices(batches, "t"):
        data, off = text_bytes(batch.column("t"))
        if len(data):
            n = np.diff(np.searchsorted(spans(data, off, _TERM)[0], off))
            docs, words = docs + int((n > 0).sum()), words + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([words])], names=["docs", "words"])


def _shard(n_docs: int, n_terms: int) -> Arrow:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SHARD_BYTES):
            words, off = terms(batch.column("t"))
            n = np.diff(off)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            order = np.argsort(words, kind="stable")  # documents stay in order within a term
            words, doc = words[order], doc[order]
            first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])]) if len(words) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[first, len(words)])
            words, doc = words[first], doc[first]
            start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
            found = impacts(tf, n[doc], n_docs, n_terms)
            row = [[batch.column("d").to_pylist()], [len(n)], [words[start].tobytes()], [np.r_[start, len(words)].astype(np.int32).tobytes()], [doc.tobytes()], [found.astype(np.int32).tobytes()]]
            kinds = [pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["doc_ids", "n_docs", "terms", "starts", "docs", "impacts"])

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows, written to the shared folder.

    The first pass counts documents and terms, the second makes the shards; no
    shuffle, a shard at a time is in memory, and a lost task makes its shards
    again. Ids must be whole numbers. Null, empty and blank texts have no terms:
    they count for nothing and are never found. Repeated rows and null or
    repeated ids are documents of their own; other columns are ignored; an
    empty table gives an index that finds nothing.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    total = rows.select("t").mapInArrow(_count, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)
    shards = rows.mapInArrow(_shard(n_docs, max(1, n_terms)), "doc_ids array<long>, n_docs long, terms binary, starts binary, docs binary, impacts binary")
    return Index(materialize(shards, "lexical-index"), n_docs, n_terms)


# -- searching -------------------------------------------------------------------


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each query and how often it has them."""
    for batch in slices(batches, "t"):
        words, off = terms(batch.column("t"))
        found = [np.unique(words[a:b], return_counts=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("item"), pa.array([len(w) for w, _ in found], pa.int64()), pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([c.astype(np.int64).tobytes() for _, c in found], pa.binary())],
            names=["row", "item", "n", "terms", "counts"],
        )


def _document_counts(wanted: np.ndarray) -> Arrow:
    """How many documents hold each of the wanted terms (sorted), from the shards' dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                here, start = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(starts.as_buffer(), np.int32)
                at, hit = _places(here, wanted)
                df[hit] += start[at + 1] - start[at]
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit])], names=["term", "df"])

    return run


def _places(here: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted terms stand in a sorted dictionary, and which of them do."""
    at = np.searchsorted(here, wanted)
    hit = np.flatnonzero(at < len(here))
    hit = hit[here[at[hit]] == wanted[hit]]
    return at[hit], hit


def best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, of equal ones those of least ``order``, in no order."""
    found = np.flatnonzero(score > 0)
    if len(found) <= k:
        return found
    s = score[found]
    least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
    sure, tied = found[s > least], found[s == least]
    room = k - len(sure)
    if len(tied) > room:
        tied = tied[np.argpartition(order[tied], room - 1)[:room]]
    return np.r_[sure, tied]


def _search(wanted: np.ndarray, weights: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Arrow:
    """The k best documents of a task's shards for each query; a query has places among the wanted terms, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_score = [np.zeros(0, np.int64)] * len(queries)
        top_id, top_null = list(top_score), [np.zeros(0, bool)] * len(queries)
        for batch in batches:
            for row in range(batch.num_rows):
                term, start, docs, impact = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("terms", np.uint64), ("starts", np.int32), ("docs", np.int32), ("impacts", np.int32)))
                at, hit = _places(term, wanted)
                if not len(hit):
                    continue
                ids = batch.column("doc_ids")[row].values
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.empty(len(ids), np.int64)
                order[np.lexsort((ids, null))] = np.arange(len(ids))
                low, high = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
                low[hit], high[hit] = start[at], start[at + 1]
                for q, (places, counts) in enumerate(queries):
                    here = high[places] > low[places]
                    if not here.any():
                        continue
                    score = np.zeros(len(ids), np.int64)
                    for t, times in zip(places[here].tolist(), counts[here].tolist(), strict=True):
                        a, b = low[t], high[t]
                        score[docs[a:b]] += impact[a:b] * (times * weights[t])
                    found = best(score, order, k)
                    s, i, o = np.r_[top_score[q], score[found]], np.r_[top_id[q], ids[found]], np.r_[top_null[q], null[found]]
                    keep = np.lexsort((i, o, -s))[:k]
                    top_score[q], top_id[q], top_null[q] = s[keep], i[keep], o[keep]
        number = np.repeat(np.arange(len(queries)), [len(s) for s in top_score])
        if len(number):
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.concatenate(top_id), mask=np.concatenate(top_null)), pa.array(np.concatenate(top_score))], names=["query", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the k documents of highest score above 0 for each item, equal ones by id.

    All items meet all shards, a block of at most ``BLOCK_QUERIES`` items and
    about ``BLOCK_TERMS`` terms at a time: a block reads the shards'
    dictionaries for the document counts of its terms and then their postings.
    Only a block's terms and counts reach the driver. A task keeps k documents
    for each item.

    Items without terms (null or empty texts) and items whose terms no document
    has give no rows; items with one id, or none, are each searched for
    themselves. Documents without id come after all others of their score; of
    repeated documents each takes a rank. Empty tables give no rows.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t"))
    asked = materialize(rows.mapInArrow(_query_terms, f"row long, item {kind}, n long, terms binary, counts binary").where("n > 0"), "queries")
    size = asked.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = max(-(-size[0] // BLOCK_QUERIES), -(-(size[1] or 0) // BLOCK_TERMS))
    out = spark.createDataFrame([], f"item {kind}, row long, doc_id long, score long")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "terms", "counts").collect()
        if not part:
            continue
        own = [np.frombuffer(r["terms"], np.uint64) for r in part]
        wanted = np.unique(np.concatenate(own))
        queries = [(np.searchsorted(wanted, t), np.frombuffer(r["counts"], np.int64)) for t, r in zip(own, part, strict=True)]
        df = np.zeros(len(wanted), np.int64)
        for term, n in index.shards.select("terms", "starts").mapInArrow(_document_counts(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[term] = n
        weights = np.array([weight(index.n_docs, n) for n in df.tolist()], np.int64)
        found = index.shards.select("doc_ids", "terms", "starts", "docs", "impacts").mapInArrow(_search(wanted, weights, queries, k), "query int, doc_id long, score long")
        first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["row"]) for q, r in enumerate(part)], "query int, row long")
        out = out.unionAll(found.join(names, "query").join(asked.select("row", "item"), "row").select("item", "row", "doc_id", "score"))
    place = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.select(F.col("item").alias(id_col), F.row_number().over(place).alias("rank"), "doc_id", "score")
