"""What contents consist of, as sorted arrays of numbers, so that pairs are bounded without their texts.

A unit is a code point or a line with its terminator. A dictionary gives every
unit of a comparison one number: a code point is its own, lines get theirs from
one table of all distinct lines. A content's profile is its units' numbers in
order, how often each occurs, and its bytes. What two contents can share at
most comes from merging two such arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.plans.lineage import cut

_PROFILE = "blob_id string, unit_mode string, ids binary, counts binary, bytes binary"


def _profile_rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    arrays = [pa.array([np.ascontiguousarray(f[i]).astype(kind).tobytes() for f in found], pa.binary()) for i, kind in enumerate(("<i8", "<i4", "<i4"))]
    return pa.RecordBatch.from_arrays([batch.column("blob_id"), batch.column("unit_mode"), *arrays], names=[c.split(" ")[0] for c in _PROFILE.split(", ")])


def _scalars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            ids, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
            found.append((ids, counts, 1 + (ids > 0x7F) + (ids > 0x7FF) + (ids > 0xFFFF)))
        yield _profile_rows(batch, found)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("units").to_pylist()
        yield _profile_rows(batch, [tuple(np.array([u[c] for u in units], np.int64) for c in ("id", "n", "bytes")) for units in rows])


def line_dictionary(texts: DataFrame) -> DataFrame:
    """(unit, id) of every distinct line of ``texts`` (text), its terminator with it."""
    lines = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("unit"))
    return cut(lines.distinct().withColumn("id", F.monotonically_increasing_id()))


def profiles(contents: DataFrame) -> DataFrame:
    """(blob_id, unit_mode, ids, counts, bytes) of ``contents`` (blob_id, unit_mode, text), each given once; binary, 64 and 32 bits little-endian.

    An empty text has empty arrays. Numbers of lines hold within one call.
    """
    scalar = contents.where("unit_mode = 'scalar'").select("blob_id", "unit_mode", "text").mapInArrow(_scalars, _PROFILE)
    by_line = contents.where("unit_mode = 'line'").select("blob_id", "unit_mode", "text")
    units = by_line.select("blob_id", F.explode(F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("unit")).groupBy("blob_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    known = units.join(line_dictionary(by_line), "unit").select("blob_id", F.struct("id", "n", F.octet_length("unit").alias("bytes")).alias("u"))
    listed = known.groupBy("blob_id").agg(F.array_sort(F.collect_list("u")).alias("units")).select("blob_id", F.lit("line").alias("unit_mode"), "units")
    return scalar.unionAll(listed.mapInArrow(_lines, _PROFILE))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = [[np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] for side in ("old", "new") for c, kind in ((f"{side}_ids", "<i8"), (f"{side}_counts", "<i4"), (f"{side}_bytes", "<i4"))]
        bound, matches, shared = [], [], []
        for a, an, ab, b, bn, _ in zip(*views, strict=True):
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
            n, m = an[both].astype(np.int64), bn[at[both]].astype(np.int64)
            bound.append(int((np.minimum(n, m) * ab[both]).sum()))
            matches.append(int((n * m).sum()))
            shared.append(int(((n == 1) & (m == 1)).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("old_blob", "new_blob", "unit_mode")), pa.array(bound, pa.int64()), pa.array(matches, pa.int64()), pa.array(shared, pa.int64())], names=["old_blob", "new_blob", "unit_mode", "bound", "matching_pairs", "common_singles"])


def measures(pairs: DataFrame, old_texts: DataFrame, new_texts: DataFrame) -> DataFrame:
    """Of distinct ``pairs`` (old_blob, new_blob, unit_mode): bound, matching_pairs, common_singles; sides are (blob_id, text), each content once.

    ``bound`` is the most bytes that units can share by their counts,
    ``matching_pairs`` how many places of the two have equal units, and
    ``common_singles`` how many units stand once in both. Texts are read for
    their profiles only, once for each content and mode; pairs meet profiles.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = lambda c: pairs.select(F.col(c).alias("blob_id"), "unit_mode")
    texts = old_texts.select("blob_id", "text").unionAll(new_texts.select("blob_id", "text")).where("text is not null").dropDuplicates(["blob_id"])
    made = cut(profiles(cut(asked("old_blob").unionAll(asked("new_blob")).distinct().join(texts, "blob_id").select("blob_id", "unit_mode", "text"))))
    side = lambda s: made.select(F.col("blob_id").alias(f"{s}_blob"), "unit_mode", *(F.col(c).alias(f"{s}_{c}") for c in ("ids", "counts", "bytes")))
    met = pairs.join(side("old"), ["old_blob", "unit_mode"]).join(side("new"), ["new_blob", "unit_mode"]).repartition(tasks, "old_blob", "new_blob")
    return met.mapInArrow(_merged, "old_blob string, new_blob string, unit_mode string, bound long, matching_pairs long, common_singles long")
