"""Packing by power-of-two decomposition.

A document of n ids becomes n // L pieces of the longest length L and one piece
for each set bit of the rest, longest first. Every piece is a sequence of its
own, so no sequence crosses documents, nothing is padded, and a trainer draws
batches from the buckets of equal length (``seq_len``): each task returns its
pieces bucket by bucket, longest first, numbered within their bucket.

The work is one pass without a shuffle, and a sort within the task that spills
where it must: memory is bounded, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .tokens import Encoder

TOKENIZER, END_ID, LONGEST = "word_bpe_49k.json", 2, 4096
#: Sequence ids are (task number << SEQUENCE_BITS) + (log2 of the length << BUCKET_BITS) + number in the task's bucket.
SEQUENCE_BITS, BUCKET_BITS = 40, 35


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole ones first, then the rest's binary digits, longest first."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pack(tokenizer: str, end_id: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, blank_leads=False)
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << SEQUENCE_BITS
        following: dict[int, int] = {}  # the next id of each bucket
        for batch in slices(batches, "t"):
            ids, off = encoder.encode_array(batch.column("t"))
            wide = np.insert(ids.astype("<u4"), off[1:], end_id).tobytes()
            doc, start, length, total, number, data = [], [], [], [], [], []
            base = 0
            for row, n in enumerate((np.diff(off) + 1).tolist()):
                at = 0
                for size in cuts(n, longest):
                    doc.append(row)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    own = following.setdefault(size, task + (size.bit_length() - 1 << BUCKET_BITS))
                    number.append(own)
                    following[size] = own + 1
                    data.append(wide[4 * (base + at) : 4 * (base + at + size)])
                    at += size
                base += n
            count = len(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array([0] * count, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "seq_len", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, seq_len, ids.

    ``ids`` is binary, little-endian unsigned 32-bit. ``offset`` is always 0 and
    ``seq_len`` equals ``length``, as each piece fills its sequence. Within a
    partition rows are in order of ``seq_len``, longest first, and sequence ids
    of one length follow each other.

    Null or empty texts give the end id alone, one piece of length 1. Repeated
    rows and null or repeated doc_ids are packed row by row; an empty table
    gives no rows; other columns are ignored. Sequence ids are unique in a run;
    they hold the number of the input partition, so they repeat between runs
    over the same files.
    """
    schema = f"doc_id {dict(docs.select(F.col(id_col).alias('d')).dtypes)['d']}, start long, length long, doc_tokens long, sequence_id long, offset long, seq_len long, ids binary"
    pieces = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(_pack(tokenizer, end_id, longest), schema)
    return pieces.sortWithinPartitions(F.desc("seq_len"), "sequence_id")
