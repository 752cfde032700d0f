"""The folder that driver and executors share, for tables that cut lineage and for results of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The hint for joins of written tables by session and bin: on disk they take some hundredth of their rows' size, so that the planner would send whole ones through the driver.
SHUFFLED = "shuffle_hash"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under the machine's temporary folder only in local mode, where that is unset.

    What is in it is deleted when the application ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read back: what several branches need is computed once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df by columns in just as many partitions as the session shuffles to.

    The planner gathers shuffled partitions by their size on disk; where rows take some tenth of their size there, one task would sort more the larger the tables are.
    For the same reason a join of it is not turned into a broadcast.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns).hint("merge")
