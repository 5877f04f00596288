"""Token ids in files of byte-aligned variable-length codes.

Ids are replaced by their rank by frequency over the whole corpus, so common
ones get one byte. Codes of a block stand apart from its control bytes: every
control byte has the lengths of four codes, two bits each, and tells a reader
where the next codes start. Decoding looks the four lengths up in a table for
all control bytes at once; numpy then gathers the codes by length.

A file is a table of blocks, each a run of whole documents in ascending order
of id: ``bucket`` (its range of ids), ``before`` (ids of that range in earlier
blocks), ``doc_ids``, ``lengths``, ``control``, ``codes`` and ``n_tokens``.
``ranks.parquet`` beside it turns ranks into ids again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges as id_ranges
from .batches import slices
from .shared import new_path
from .tokens import Encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Ids of one block, unless one document has more.
BLOCK_TOKENS = 1 << 16

#: Lengths of the four codes of every control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and codes of ``ranks`` (unsigned 32-bit); codes are little-endian."""
    n = len(ranks)
    size = np.ones(n, np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        size += ranks >= limit
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(n, 4)
    codes = raw[np.arange(4)[None, :] < size[:, None]]
    return control.tobytes(), codes.tobytes()


def decode(control: bytes, codes: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks again."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.r_[0, np.cumsum(size)]
    raw = np.frombuffer(codes, np.uint8)
    if len(raw) != start[-1] or len(size) != n:
        raise ValueError("control bytes and codes do not match")
    out = np.zeros(n, np.uint32)
    for byte in range(4):
        has = np.flatnonzero(size > byte)
        if len(has):
            out[has] |= raw[start[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def rank_table(counts: np.ndarray) -> np.ndarray:
    """Ids by descending count, then ascending id."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


def _tokenize(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, blank_leads=True)
        width = encoder.dtype.itemsize
        for batch in slices(batches, "t"):
            ids, off = encoder.encode_array(batch.column("t"))
            raw = np.insert(ids, off[1:], end_id).tobytes()
            ends = (off + np.arange(len(off))).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([raw[width * a : width * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["d", "ids"])

    return run


def _counts(dtype: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype))
            if len(got) > len(total):
                total = np.r_[total, np.zeros(len(got) - len(total), np.int64)]
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return run


def _ranked(dtype: np.dtype, rank_of: np.ndarray, edges: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's ranks, compressed, with the range it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "ids", 1 << 20):
            docs = [np.frombuffer(x, dtype) for x in batch.column("ids").to_pylist()]
            ids = batch.column("d").to_pylist()
            small = [pack.compress(rank_of[x].tobytes()) for x in docs]
            yield pa.RecordBatch.from_arrays([pa.array([id_ranges.of(d, edges) for d in ids], pa.int32()), batch.column("d"), pa.array(small, pa.binary())], names=["bucket", "d", "ranks"])

    return run


def _blocks(dtype: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["bucket", "before", "doc_ids", "lengths", "control", "codes", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        unpack = zstandard.ZstdDecompressor()
        bucket, before, docs, data, held = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, data, held, before
            parts = [np.frombuffer(x, dtype) for x in data]
            control, codes = encode(np.concatenate(parts).astype(np.uint32))
            row = [[bucket], [before], [docs], [[len(p) for p in parts]], [control], [codes], [sum(map(len, parts))]]
            before += held
            docs, data, held = [], [], 0
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for b, d, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "d", "ranks")), strict=True):
                raw = unpack.decompress(raw)
                if docs and (b != bucket or held >= BLOCK_TOKENS):
                    yield flush()
                if b != bucket:
                    bucket, before = b, 0
                docs.append(d)
                data.append(raw)
                held += len(raw) // dtype.itemsize
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> None:
    """Writes every text's ids, each with ``end_id`` after them, to ``path`` in the format above.

    Texts are encoded once; their ids wait in the shared folder while they are
    counted. The table of counts has an entry for each id of the vocabulary.

    Null and empty texts have the end id alone. Null doc_ids come first; rows
    that repeat an id are ordered by their ids' bytes. An empty table gives files
    without blocks; other columns are ignored. Ids of documents must be integers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = Encoder.of(tokenizer, blank_leads=True).dtype
    raw_path = new_path(spark, "ids")
    rows.mapInArrow(_tokenize(tokenizer, end_id), "d long, ids binary").write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema("d long, ids binary").parquet(raw_path)
    counts = raw.select("ids").mapInArrow(_counts(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    total = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    by_rank = rank_table(total)
    rank_of = np.empty(len(by_rank), dtype)
    rank_of[by_rank] = np.arange(len(by_rank))
    edges = id_ranges.bounds(raw, "d", ranges)
    dealt = raw.mapInArrow(_ranked(dtype, rank_of, edges), "bucket int, d long, ranks binary").repartitionById(ranges, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", F.col("d").asc_nulls_first(), "ranks")
    blocks = dealt.mapInArrow(_blocks(dtype), "bucket int, before long, doc_ids array<long>, lengths array<long>, control binary, codes binary, n_tokens long")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks.parquet")
    spark.createDataFrame([(by_rank.tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks.parquet")


def _read(by_rank: np.ndarray, before: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids = by_rank[decode(r["control"], r["codes"], r["n_tokens"])].astype("<u4").tobytes()
                size = np.array(r["lengths"], np.int64)
                ends = np.cumsum(size)
                data = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + before[r["bucket"]] + ends - size, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit).

    Positions of ranges come from the sizes that their blocks state; a number for each range reaches the driver.
    """
    blocks = spark.read.parquet(f"{path}/blocks.parquet")
    sizes = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()
    before, total = {}, 0
    for r in sizes:
        before[r.bucket] = total
        total += r.n
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks.parquet").first().ids, np.uint32)
    return blocks.mapInArrow(_read(by_rank, before), "doc_id long, start long, n_tokens long, ids binary")
