"""Line diffs as rows: alignment, statistics, hunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import sequences

#: Rows of one Arrow batch, which holds those of many pairs.
BATCH_ROWS = 8192
_ROWS = "row_no int, kind string, old_no int, old_text string, new_no int, new_text string"


def aligned_rows(pairs: DataFrame, key: list[str], old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Rows of a patience line diff for each pair: the key, row_no from 0, kind, and number and text on either side.

    Null texts are empty. A pair's rows come from one call; a task holds
    one batch of rows at a time.
    """
    fields = [pairs.schema[k] for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []

            def made(batch=batch) -> pa.RecordBatch:
                own = batch.select(key).take(pa.array(of, pa.int64()))
                out = pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*key, *names])
                rows.clear()
                of.clear()
                return out

            for n, (a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_old", "_new")), strict=True)):
                own = sequences.aligned_rows(a or "", b or "")
                rows += [(i, *r) for i, r in enumerate(own)]
                of += [n] * len(own)
                if len(rows) >= BATCH_ROWS:
                    yield made()
            if rows:
                yield made()

    names = [c.split(" ")[0] for c in _ROWS.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + _ROWS
    return pairs.select(*key, F.col(old).alias("_old"), F.col(new).alias("_new")).mapInArrow(run, schema)


def diff_stats(rows: DataFrame, key: list[str]) -> DataFrame:
    """Lines added and removed for each pair; a change counts as both."""
    return rows.groupBy(*key).agg(F.sum(F.when(F.col("kind").isin("add", "change"), 1).otherwise(0)).cast("long").alias("added"), F.sum(F.when(F.col("kind").isin("delete", "change"), 1).otherwise(0)).cast("long").alias("removed"))


def bag_stats(pairs: DataFrame, key: list[str], old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Lines of either side that the other lacks, by count and not by place: the least that any alignment can report."""
    lines = lambda c, sign: pairs.select(*key, F.explode(F.split(F.col(c), "\n", -1)).alias("line"), F.lit(sign).alias("sign"))
    net = lines(old, -1).unionAll(lines(new, 1)).groupBy(*key, "line").agg(F.sum("sign").alias("net"))
    return net.groupBy(*key).agg(F.sum(F.greatest("net", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("removed"))


def positional_rows(pairs: DataFrame, key: list[str], old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Rows that compare the i-th line with the i-th line: row_no from 0 and changed."""
    a, b = F.split(F.col(old), "\n", -1), F.split(F.col(new), "\n", -1)
    zipped = pairs.select(*key, F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("row_no", "line"))
    return zipped.select(*key, "row_no", (~F.col("line.a").eqNullSafe(F.col("line.b"))).alias("changed"))


def hunk_windows(rows: DataFrame, key: list[str], radius: int = 3) -> DataFrame:
    """Windows around changed rows that touch or overlap, as gaps and islands: hunk_no from 1, first and last row, changes.

    ``rows`` have the key, row_no and changed. Windows keep within the rows.
    """
    total = rows.groupBy(*key).agg(F.max("row_no").alias("end"))
    order = Window.partitionBy(*key).orderBy("row_no")
    changed = rows.where("changed").withColumn("fresh", F.when(F.col("row_no") - radius > F.lag("row_no").over(order) + radius + 1, 1).when(F.lag("row_no").over(order).isNull(), 1).otherwise(0))
    islands = changed.withColumn("hunk_no", F.sum("fresh").over(order))
    hunks = islands.groupBy(*key, "hunk_no").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b"), F.count(F.lit(1)).alias("changes")).join(total, key)
    return hunks.select(*key, F.col("hunk_no").cast("long").alias("hunk_no"), F.greatest(F.col("a") - radius, F.lit(0)).cast("long").alias("first_row"), F.least(F.col("b") + radius, F.col("end")).cast("long").alias("last_row"), "changes")


def collapsed_gaps(windows: DataFrame, key: list[str]) -> DataFrame:
    """Rows hidden between a window and the next one."""
    order = Window.partitionBy(*key).orderBy("hunk_no")
    return windows.withColumn("hidden", F.lead("first_row").over(order) - F.col("last_row") - 1).where("hidden is not null").select(*key, "hunk_no", "hidden")


def unified_hunks(pairs: DataFrame, key: list[str], old: str = "old_text", new: str = "new_text") -> DataFrame:
    """The key and ``hunks``: unified diff text with a context of three lines."""
    made = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: sequences.unified(x or "", y or "")), "string")
    return pairs.select(*key, made(F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))).alias("hunks"))


def diff_document(events: DataFrame, key: list[str]) -> DataFrame:
    """Each event's text: its header by status, then its hunks. Events have status, old_path, path, old_text, new_text."""
    old, new = F.coalesce("old_path", "path"), F.coalesce("path", "old_path")
    hunked = events.join(unified_hunks(events, key), key)
    same = F.coalesce("old_text", F.lit("")) == F.coalesce("new_text", F.lit(""))
    names = F.concat(
        F.lit("--- "), F.when(F.col("status") == "added", F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), old)), F.lit("\n+++ "),
        F.when(F.col("status") == "deleted", F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), new)), F.lit("\n"), "hunks",
    )
    rename = F.when(F.col("status") == "moved", F.concat(F.lit("rename from "), old, F.lit("\nrename to "), new, F.lit("\n"))).otherwise("")
    return hunked.select(*key, F.concat(F.lit("diff a/"), old, F.lit(" b/"), new, F.lit("\n"), rename, F.when(same, "").otherwise(names)).alias("document"))


def show_document(files: DataFrame, by: list[str]) -> DataFrame:
    """One text for each group of files (path, canonical_text): a header and the text of each, in order of path, a blank line between."""
    section = F.concat(F.lit("== "), "path", F.lit(" ==\n"), "canonical_text")
    return files.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.encode("path", "UTF-8").alias("k"), section.alias("s")))), lambda x: x["s"]), "\n").alias("document"))


def gutter_widths(rows: DataFrame, key: list[str]) -> DataFrame:
    """Digits of the largest line number on either side of aligned rows, 1 at least: what a view reserves for numbers."""
    digits = lambda c: F.greatest(F.lit(1), F.coalesce(F.length(F.max(c).cast("string")), F.lit(1))).cast("int")
    return rows.groupBy(*key).agg(digits("old_no").alias("old_width"), digits("new_no").alias("new_width"))


def line_widths(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Lines of each text and the code points of its longest one; null texts have one empty line."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return texts.select(*key, F.size(parts).alias("lines"), F.array_max(F.transform(parts, F.length)).alias("width"))


def side_by_side(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """Aligned rows as two columns of ``width`` code points: the key, row_no, kind, left and right, each wrapped into an array of equal length."""

    def wrapped(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / width).cast("int") - 1)), lambda i: F.substring(text, i * width + 1, F.lit(width)))

    made = rows.select(*key, "row_no", "kind", wrapped("old_text").alias("l"), wrapped("new_text").alias("r"))
    most = F.greatest(F.size("l"), F.size("r"))
    fill = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(""), most - F.size(c)))
    return made.select(*key, "row_no", "kind", fill("l").alias("left"), fill("r").alias("right"))
