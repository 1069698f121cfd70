"""Tables in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is not set.

    A warehouse on a machine's own disk is refused unless Spark runs on that machine alone. The folder goes when the
    driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """df as a table there: made once, though it is read more than once, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession, 'table')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
