from pyspark.sql import functions as F

from lithos.streaming.snapshots import watch


def test_each_request_is_compared_once(spark, tmp_path):
    asked, out, state = (str(tmp_path / n) for n in ("asked", "out", "state"))
    rows = spark.createDataFrame([("r", "1", "a", "x", "one"), ("r", "2", "b", "x", "one"), ("r", "3", "b", "x", "two")], "repo string, snapshot string, path string, language string, text string")
    rows = rows.withColumn("blob_id", F.sha1("text")).withColumn("size", F.octet_length("text").cast("long"))
    for base, target in (("1", "2"), ("2", "3")):
        spark.createDataFrame([("r", base, target)], "repo string, base string, target string").write.mode("append").parquet(asked)
        stream = spark.readStream.schema("repo string, base string, target string").parquet(asked)
        query = watch(stream, lambda wanted: rows.join(wanted, ["repo", "snapshot"]), out, state, once=True)
        query.awaitTermination(60)
    found = {(r.base, r.target, r.status, r.old_path, r.path) for r in spark.read.parquet(out).collect()}
    assert found == {("1", "2", "moved", "a", "b"), ("2", "3", "modified", "b", "b")}
