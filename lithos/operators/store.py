"""Items of contents, parsed once however many paths, sides of a comparison and steps of a history have them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators import projection
from lithos.plans.lineage import cut

#: Stands for the path in stored keys.
PLACE = "\ue000"
_SCHEMA = f"blob_id string, {projection.SCHEMA}, language string"


class ProjectionStore:
    """Parquet files of items by (blob_id, language), all modes, keys without their path.

    A content is known once it has a row: its items, its error, or a mark that it
    declares nothing. What is missing is found by an anti join of ids, and only
    that is read, dealt to all tasks, parsed and appended by one job, so a failed
    job leaves nothing behind. One writer at a time; a store that later versions
    of the projectors should not use needs a path of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._write(spark.createDataFrame([], _SCHEMA), "first")  # so that there is something to read

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").partitionBy("language").parquet(f"{self.path}/fill={name}")

    def rows(self) -> DataFrame:
        """All rows by now. Fills are folders of their own, so that a plan over fewer of them is no plan over these."""
        return self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(f"{self.path}/fill=*")

    def fill(self, files: DataFrame, read: Callable[[DataFrame], DataFrame]) -> int:
        """Parses contents of ``files`` (blob_id, language, and what ``read`` needs) that are not known yet; how many.

        ``read`` takes some of the rows, one for each content, and gives blob_id,
        language and content (binary or string). Files without an id, or of a
        language without projector, are passed over.
        """
        asked = files.where(F.col("blob_id").isNotNull() & F.col("language").isin(list(projection.PROJECTORS)))
        missing = cut(asked.select("blob_id", "language").distinct().join(self.rows().select("blob_id", "language").distinct(), ["blob_id", "language"], "left_anti"))
        count = missing.count()
        if count:
            wanted = asked.join(missing, ["blob_id", "language"], "left_semi").dropDuplicates(["blob_id", "language"])
            contents = read(wanted).select("blob_id", "language", "content", F.lit(PLACE).alias("place"))
            found = projection.items(contents, ["blob_id"], path="place", content="content", marked=True).drop("path")
            self._write(found.select([c.split(" ")[0] for c in _SCHEMA.split(", ")]), uuid.uuid4().hex)
        return count

    def items(self, files: DataFrame, key: list[str]) -> DataFrame:
        """Items of ``files`` (key, path, language, blob_id), as ``projection.items`` gives them; contents must be known."""
        by = list(dict.fromkeys([*key, "path"]))
        there = lambda c: F.when(F.startswith(F.col(c), F.lit(PLACE)), F.concat("path", F.expr(f"substring({c}, 2)"))).otherwise(F.col(c)).alias(c)
        names = [c.split(" ")[0] for c in projection.SCHEMA.split(", ")]
        met = files.select(*by, "language", "blob_id").join(self.rows().where("mode is not null or error is not null"), ["blob_id", "language"])
        return met.select(*by, "language", *(there(c) if c in ("stable_key", "parent_key") else F.col(c) for c in names))
