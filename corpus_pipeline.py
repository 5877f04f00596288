"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Every stage takes all that the stage before it kept, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import decontaminate, minhash, packing, pii, toxicity
from lithos.llm.shared import delete, materialize, new_path, temporary, tune


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose restored form scores as toxic go.

    Null and empty texts score as texts without words; repeated rows and ids, or
    null ids, are decided row by row; of an empty table nothing stays. Columns
    come back as they are, whatever their names.
    """
    tune(spark)
    model = toxicity.char_model(docs)
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), model)
    return toxicity.without_toxic(docs, model, scorer)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row of the smallest id stays.

    Where ids repeat or are null, rows are compared by a key of their own, so of
    rows with one id or none still one stays; a null counts as the largest id.
    Null, empty and blank texts are like nothing and all stay. Columns come back
    as they are; an empty table gives no rows.
    """
    tune(spark)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
        found = minhash.near_duplicates(keyed, k=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
        first = found.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("s"))
        return keyed.join(first.select("s._row"), "_row", "left_semi").select(docs.columns)
    found = minhash.near_duplicates(docs, k=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go.

    Null and empty texts hold none and stay; rows are decided one by one, so
    repeated or null ids are no matter; without items, or without rows, nothing
    changes.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every row stays, null texts as null.

    ``n_chars`` is counted again where a text changed; rows are redacted one by
    one; an empty table gives no rows.
    """
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document, each a sequence of its own.

    Null and empty texts give one piece, the end id; rows are packed one by one,
    so repeated or null ids give pieces for each; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Tokenizers and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's input and scratch tables go when its output stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with temporary(spark):  # what a stage wrote on its way
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
