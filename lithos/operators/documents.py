"""The two JSON documents that tools read: one of a snapshot's files, one of the differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators.projection import canonical_files, outline

SHOW, DIFF = "show.v1", "diff.v2"


def _span() -> Column:
    """Lines count from 1, bytes from 0."""
    return F.struct((F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), "start_byte", "end_byte").alias("span")


def _ordered(*columns: Column | str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ordinal", *columns))), lambda x: x.dropFields("ordinal"))


def file_structs(rows: DataFrame, key: list[str], mode: str) -> DataFrame:
    """(key, path, language, file): the projection in one mode, text and items, and the outline of each file, as a struct."""
    by = list(dict.fromkeys([*key, "path"]))
    own = rows.where((F.col("mode") == mode) & F.col("error").isNull()).groupBy(*by).agg(_ordered("stable_key", "parent_key", "kind", "name", _span(), "canonical_text").alias("items"))
    marked = outline(rows, key, mode).groupBy(*by).agg(F.first("language").alias("language"), _ordered("stable_key", "parent_key", "kind", "name", _span(), F.col("canonical_text").alias("signature"), F.col("retained").alias("retained_in_mode")).alias("outline"))
    texts = canonical_files(rows, marked, key, mode)
    both = marked.join(own, by, "left").join(texts, by, "left")
    shown = F.struct(F.col("canonical_text").alias("text"), F.coalesce("items", F.array()).alias("items")).alias("projection")
    return both.select(*by, "language", F.struct("path", "language", shown, "outline").alias("file"))


def show_document(rows: DataFrame, files: DataFrame, mode: str, revision: str | None) -> DataFrame:
    """(repo, document) of every repo: its files, also those that declare nothing, in order of path."""
    made = file_structs(rows, ["repo", "path"], mode)
    nothing = F.struct("path", "language", F.struct(F.lit("").alias("text"), F.array().alias("items")).alias("projection"), F.array().alias("outline"))
    every = files.select("repo", "path", "language").join(made.select("repo", "path", "file"), ["repo", "path"], "left")
    shown = every.withColumn("file", F.coalesce(F.to_json("file"), F.to_json(nothing)))
    # a file's object is text by now, so the document is put together and not built anew
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.encode("path", "UTF-8").alias("k"), "file"))), lambda x: x["file"])
    head = F.to_json(F.struct(F.lit(SHOW).alias("schema"), F.lit("revision" if revision else "files").alias("input"), F.lit(revision).cast("string").alias("revision"), F.lit(mode).alias("mode")))
    return shown.groupBy("repo").agg(F.concat(F.rtrim(head, F.lit("}")), F.lit(',"files":['), F.array_join(ordered, ","), F.lit("]}")).alias("document"))


def diff_document(events: DataFrame, base: DataFrame, target: DataFrame, mode: str, base_id: str, target_id: str) -> DataFrame:
    """One document of events (repo, status, old_path, path, language); sides are item rows by (repo, path).

    A move whose paths are equal cannot be told from an edit and is an error.
    """
    side = lambda rows, path, name: file_structs(rows, ["repo", "path"], mode).select("repo", F.col("path").alias(path), F.col("file").alias(name))
    checked = events.withColumn("status", F.when((F.col("status") == "moved") & (F.col("old_path") == F.col("path")), F.raise_error(F.lit("a move needs two paths"))).otherwise(F.col("status")))
    both = checked.join(side(base, "old_path", "base"), ["repo", "old_path"], "left").join(side(target, "path", "target"), ["repo", "path"], "left")
    place = F.coalesce("path", "old_path")
    entry = F.struct(place.alias("path"), F.when(F.col("status") == "moved", F.col("old_path")).alias("old_path"), "language", "status", "base", "target")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.encode(place, "UTF-8").alias("k"), entry.alias("e")))), lambda x: x["e"])
    head = [F.lit(DIFF).alias("schema"), F.lit(mode).alias("mode"), F.lit(base_id).alias("base"), F.lit(target_id).alias("target")]
    return both.groupBy("repo").agg(F.to_json(F.struct(*head, ordered.alias("files"))).alias("document"))
