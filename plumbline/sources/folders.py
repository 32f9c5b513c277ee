"""Shared working folder for streams, checkpoints and intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, else under the session's warehouse.

    Both are shared by driver and executors; the owner of the folder clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, for results that several operators use."""
    spark = df.sparkSession
    folder = working_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
