"""Small helpers of the text operators: tables, shared folders, neighbours, row keys."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is not installed on them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors see: under ``spark.checkpoint.dir``, else under the warehouse.

    Nothing is removed here; the owner of the shared folder clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/plumbline-{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession, purpose)}/{purpose}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column, separator: str = WHITE_SPACE) -> Column:
    """Array of words; no empty ones."""
    return F.array_remove(F.split(text, separator), "")


def window_hashes(words: Column, size: int) -> Column:
    """64-bit hash of every run of ``size`` words; for fewer words one hash of all, for none an empty array."""
    n = F.size(words)
    return (
        F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size))))
        .when(n > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<long>"))
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
