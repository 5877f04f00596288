"""Ranges of ids of about equal size, for orders over a whole table."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(rows: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ``ranges`` - 1 ascending bounds; a range starts at its bound. Reads the one column."""
    steps = [i / ranges for i in range(1, ranges)]
    return sorted({int(x) for x in rows.select(column).where(F.col(column).isNotNull()).approxQuantile(column, steps, 0.2 / ranges)})


def of(value: int | None, edges: list[int]) -> int:
    """The range of an id; null ids are in the first."""
    return 0 if value is None else bisect_right(edges, value)


def heads(rows: DataFrame, column: str, edges: list[int]) -> dict[int, int | None]:
    """The smallest id of every range that has rows, None where it has a null; a row for each range reaches the driver."""
    at = np.array(edges, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        null = False
        for batch in batches:
            ids = batch.column(0)
            null |= ids.null_count > 0
            ids = ids.drop_null().to_numpy(zero_copy_only=False)
            if len(ids):
                ids = np.sort(ids)
                places = np.searchsorted(at, ids, "right")
                first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                for b, v in zip(places[first].tolist(), ids[first].tolist(), strict=True):
                    low[b] = min(low.get(b, v), v)
        if null:
            low.setdefault(0, None)
        yield pa.RecordBatch.from_arrays([pa.array(low.keys(), pa.int32()), pa.array(low.values(), pa.int64()), pa.array([null and b == 0 for b in low], pa.bool_())], names=["b", "v", "nulls"])

    found = rows.select(F.col(column).cast("long")).mapInArrow(run, "b int, v long, nulls boolean").groupBy("b").agg(F.min("v").alias("v"), F.max("nulls").alias("nulls")).collect()
    return {r.b: None if r.nulls else r.v for r in found}
