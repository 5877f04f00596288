"""Two snapshots derived from a table of documents, so that every kind of event occurs.

A document is a file of the repository ``source`` in the language ``lang``. By
``doc_id % 7`` a file is only new (0), only old (1), extended (3), moved as it is
(4), moved and cut (5), or the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.blobs import content_id


def _files(docs: DataFrame) -> DataFrame:
    key = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    return docs.where("text is not null").select(F.col("source").alias("repo"), F.col("lang").alias("language"), (F.col("doc_id") % 7).alias("m"), F.concat("lang", F.lit("/"), key, F.lit(".txt")).alias("path"), "text")


def _entries(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", "language", content_id(F.col("text")).alias("blob_id"), F.octet_length("text").cast("long").alias("size"), "text")


def base(docs: DataFrame) -> DataFrame:
    """Entries of the old snapshot: repo, path, language, blob_id, size, text."""
    return _entries(_files(docs).where("m <> 0"))


def target(docs: DataFrame) -> DataFrame:
    """Entries of the new snapshot."""
    files = _files(docs).where("m <> 1")
    path = F.when(F.col("m").isin(4, 5), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(F.col("m") == 3, F.concat("text", F.lit(" tail"))).when(F.col("m") == 5, F.expr("substring(text, 1, cast(floor(length(text) * 4 / 5) as int))")).otherwise(F.col("text"))
    return _entries(files.select("repo", "language", path.alias("path"), text.alias("text")))


#: The same two snapshots in DuckDB's SQL, as CTEs base and target.
SQL = """
f AS (SELECT source AS repo, lang AS language, doc_id % 7 AS m, lang || '/' || lpad(cast(doc_id AS varchar), 8, '0') || '.txt' AS path, text FROM documents WHERE text IS NOT NULL),
base AS (SELECT repo, path, language, sha1(text) AS blob_id, octet_length(encode(text))::BIGINT AS size, text FROM f WHERE m <> 0),
g AS (SELECT repo, language, CASE WHEN m IN (4, 5) THEN 'moved/' || path ELSE path END AS path,
    CASE WHEN m = 3 THEN text || ' tail' WHEN m = 5 THEN substring(text, 1, cast(floor(length(text) * 4 / 5) AS int)) ELSE text END AS text FROM f WHERE m <> 1),
target AS (SELECT repo, path, language, sha1(text) AS blob_id, octet_length(encode(text))::BIGINT AS size, text FROM g)"""
