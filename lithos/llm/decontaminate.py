"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is a small set of word shingles, a document a large one, so their
Jaccard similarity says little; what counts is the share of the item's shingles
that the document holds. Documents are therefore partitioned by the size of
their set, and each size class has one-permutation MinHash signatures of as many
bins as its largest sets have shingles, so that a shared shingle is its bin's
minimum in about two of three cases whatever the document's length. Items get a
signature for every class. A document and an item become a candidate pair when
they share a bin's minimum; items of few shingles, which could be missed so, are
searched by all their shingles. Each candidate is then verified by the exact
share of the item's shingles in the document.

An item of n shingles of which a share t is held is missed with probability
(1 - 0.63)^(t n): below 1e-11 from ``SMALL`` shingles on at t = 0.8.

Items below ``SMALL`` shingles belong to the finest class, whose bins are so many
that every shingle is its bin's minimum: with bins as for the others an item of
two shingles would be missed in one case of five.

Benchmarks share prompts. A shingle of more than ``FEW`` items is common; an item
that must have some of its other shingles in a document to reach the share is
searched by those alone, so a document that holds no more than a prompt is no
candidate of all its items. Nothing is lost: if fewer than ``LEAST_HITS`` of the
others are sure to be there, all of them are looked up, as for small items, and
items that common shingles alone could fill are searched by these too.

Documents are never shuffled. The items' signatures are sent to the executors in
blocks of ``BLOCK_SHINGLES``, one after the other, so what the driver and a task
hold has a bound that does not depend on the benchmark's size; documents are
read once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import distinct, shingles, slices
from .shared import materialize

WORDS, SHARE = 5, 0.8
#: Items with fewer shingles are searched by all of them.
SMALL = 32
#: Items of a block that may hold a shingle before it is common, and shingles of an item that a document must hold for minima to find it.
FEW, LEAST_HITS = 8, 26
#: Shingles of items that are sent to the executors at once: 16 MB with their signatures.
BLOCK_SHINGLES = 1 << 20

U64 = np.uint64
_ROW_BITS = 12


class Block:
    """Signatures of some items for every size class."""

    def __init__(self, ids: list, sets: list[np.ndarray], share: float):
        self.ids, self.sets, self.share = ids, sets, share
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        known, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, U64), return_counts=True)
        #: What an item is searched by, and whether by all of it.
        self.probes: list[np.ndarray] = []
        self.small = np.zeros(len(sets), bool)
        for i, own in enumerate(sets):
            rare = own[count[np.searchsorted(known, own)] <= FEW]
            sure = math.ceil(share * len(own) - 1e-9) - (len(own) - len(rare))
            self.probes.append(rare if sure > 0 else own)
            self.small[i] = len(own) < SMALL or 0 < sure < min(LEAST_HITS, math.ceil(share * SMALL))

    def of_class(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted probe values for documents of 2**bits bins, and the item of each."""
        if bits not in self.classes:
            values, owners = [], []
            for i, s in enumerate(self.probes):
                v = s >> U64(_ROW_BITS)
                if not self.small[i]:
                    bins = v >> U64(64 - _ROW_BITS - bits)
                    v = v[np.r_[True, bins[1:] != bins[:-1]]]  # sets are sorted: a bin's first is its minimum
                values.append(v)
                owners.append(np.full(len(v), i))
            v, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (values, owners))
            order = np.argsort(v, kind="stable")
            self.classes[bits] = v[order].astype(U64), o[order]
        return self.classes[bits]


def size_class(n: int) -> int:
    """log2 of the number of bins for a set of ``n`` shingles; classes are four times as wide as the last."""
    bits = max(4, int(n - 1).bit_length())
    return bits + bits % 2


def _search(block: Block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    small = bool(block.small.any())
    probes = np.unique(np.concatenate([s for s, few in zip(block.probes, block.small, strict=True) if few] or [np.zeros(0, U64)]) >> U64(_ROW_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets, off = distinct(*shingles(batch.column("t"), k))
            doc_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
            value = sets >> U64(_ROW_BITS)
            bits = np.array([size_class(n) if n else 4 for n in np.diff(off).tolist()])
            bins = value >> (U64(64 - _ROW_BITS) - bits.astype(U64)[doc_of])
            lowest = np.ones(len(value), bool)
            lowest[1:] = (bins[1:] != bins[:-1]) | (doc_of[1:] != doc_of[:-1])
            pairs: set[tuple[int, int]] = set()
            for b in np.unique(bits).tolist():
                probe, owner = block.of_class(b)
                mine = np.flatnonzero(lowest & (bits == b)[doc_of])
                _collect(pairs, value[mine], doc_of[mine], probe, owner)
            if small:
                hit = np.flatnonzero(_member(value, probes))
                keep = [(v, o) for v, o in (block.of_class(4),)][0]
                few = block.small[keep[1]]
                _collect(pairs, value[hit], doc_of[hit], keep[0][few], keep[1][few])
            doc, item, common, size = [], [], [], []
            for d, i in sorted(pairs):
                mine, theirs = sets[off[d] : off[d + 1]], block.sets[i]
                at = np.searchsorted(mine, theirs)
                n = int((mine[np.minimum(at, len(mine) - 1)] == theirs).sum())
                if n >= block.share * len(theirs) - 1e-9:
                    doc.append(d)
                    item.append(block.ids[i])
                    common.append(n)
                    size.append(len(theirs))
            if doc:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d").take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(common, pa.int64()), pa.array([c / s for c, s in zip(common, size, strict=True)], pa.float64())],
                    names=["doc_id", "item_id", "item_shingles", "common_shingles", "containment"],
                )

    return run


def _member(value: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Which values are among the sorted probes."""
    if not len(probe):
        return np.zeros(len(value), bool)
    filter_ = np.zeros(1 << 20, bool)
    filter_[(probe & U64((1 << 20) - 1)).astype(np.int64)] = True
    out = filter_[(value & U64((1 << 20) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = probe[np.minimum(np.searchsorted(probe, value[at]), len(probe) - 1)] == value[at]
    return out


def _collect(pairs: set[tuple[int, int]], value: np.ndarray, doc: np.ndarray, probe: np.ndarray, owner: np.ndarray) -> None:
    hit = np.flatnonzero(_member(value, probe))
    a, b = np.searchsorted(probe, value[hit], "left"), np.searchsorted(probe, value[hit], "right")
    for d, x, y in zip(doc[hit].tolist(), a.tolist(), b.tolist(), strict=True):
        pairs.update((d, i) for i in owner[x:y].tolist())


def item_blocks(items: DataFrame, k: int, share: float, id_col: str, text_col: str) -> Iterator[Block]:
    """The items' shingle sets, streamed to the driver a block at a time, in ascending id order."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null").orderBy("i", "t")
    ids, sets, total = [], [], 0
    for row in rows.toLocalIterator(prefetchPartitions=False):
        s, _ = distinct(*shingles(pa.array([row.t], pa.string()), k))
        if len(s):
            ids.append(row.i)
            sets.append(s)
            total += len(s)
        if total >= BLOCK_SHINGLES:
            yield Block(ids, sets, share)
            ids, sets, total = [], [], 0
    if ids:
        yield Block(ids, sets, share)


def contaminated(docs: DataFrame, items: DataFrame, k: int = WORDS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``share`` of the distinct ``k``-word shingles.

    Returns doc_id, item_id, item_shingles, common_shingles, containment. Words
    are runs of characters other than blank and the controls 9 to 13, A-Z
    lower-cased; a text of fewer than ``k`` words has its whole sequence as its
    one shingle.

    Null, empty and blank texts hold nothing and are held by nothing. Items
    without an id are left out. Repeated rows give their pairs again, once for
    each row on either side. Empty tables give no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    schema = f"doc_id {dict(rows.dtypes)['d']}, item_id long, item_shingles long, common_shingles long, containment double"
    found, last = None, None
    for block in item_blocks(items, k, share, item_id_col, item_text_col):
        if last is not None:  # only the block at hand stays in memory
            part = materialize(last, "contaminated")
            found = part if found is None else found.unionAll(part)
        last = rows.mapInArrow(_search(block, k), schema)
    if last is None:
        return rows.sparkSession.createDataFrame([], schema)
    return last if found is None else found.unionAll(last)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = WORDS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    A row goes by its own text, so rows with a null or repeated id are decided
    one by one. Other defined cases are as in ``contaminated``.
    """
    kept, first = docs, True
    for block in item_blocks(items, k, share, item_id_col, item_text_col):
        kept = (kept if first else materialize(kept, "clean")).mapInArrow(_clean(block, k, text_col), docs.schema)
        first = False
    return kept


def _clean(block: Block, k: int, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    search = _search(block, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            own = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text_col)], names=["d", "t"])
            bad = {i for found in search([own]) for i in found.column("doc_id").to_pylist()}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

    return run
