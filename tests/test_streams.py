"""Streams whose source is read one file per batch."""

from pyspark.sql import functions as F

from tidemark.streaming import flows

DDL = "user_id long, event_id long, at_ms double, value double"


def files(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_new_revision_supersedes(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), [[(1, 1, 0.0, 1.0), (2, 2, 0.0, 1.0)], [(1, 3, 0.0, 1.0)]]).withColumn("revision", F.col("event_id"))
    flows.recompute_changed(stream, "user_id", lambda changed: changed, str(tmp_path / "out"), str(tmp_path / "check"))
    published = spark.read.parquet(str(tmp_path / "out"))
    assert published.count() == 3
    assert sorted((r.user_id, r.revision) for r in flows.current(published, "user_id").collect()) == [(1, 3), (2, 2)]
