"""Comparing snapshots as they arrive. The engine itself is a batch one; this runs its plan for each new comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithos.operators.comparison import comparison_plan


def watch(requests: DataFrame, entries: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the events of every (repo, base, target) that the stream ``requests`` brings, as Parquet below ``path``.

    ``entries`` turns a batch of (repo, snapshot) into rows of repo, snapshot,
    path, language, blob_id, size, text. A repo asked twice in one batch is
    compared by its last snapshots. Each batch has a folder of its own, which a
    retried batch overwrites, so events are there exactly once.
    """

    def batch(asked: DataFrame, number: int) -> None:
        last = asked.groupBy("repo").agg(F.max_by(F.struct("base", "target"), "target").alias("s")).select("repo", "s.base", "s.target")
        wanted = last.select("repo", F.col("base").alias("snapshot")).unionAll(last.select("repo", F.col("target").alias("snapshot"))).distinct()
        found = entries(wanted)

        def side(name: str) -> DataFrame:
            return found.join(last.select("repo", F.col(name).alias("snapshot")), ["repo", "snapshot"]).drop("snapshot")

        comparison_plan(side("base"), side("target")).join(last, "repo").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
