"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so lost executors cost no recomputation past that point and later joins
see plain scans, whose skewed partitions adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import filesystem, hadoop_path, shared_path


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    return shared_path(spark, "arrowfen")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arrowfen_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``stored`` returned and nothing reads any more."""
    path = getattr(df, "_arrowfen_path", None)
    if path:
        filesystem(df.sparkSession, path).delete(hadoop_path(df.sparkSession, path), True)
