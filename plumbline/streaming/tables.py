"""File streams in, tables out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.folders import working_folder


def parquet_stream(spark: SparkSession, folder: str, glob: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder whose names match ``glob``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def append_available(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over all data present and read its table."""
    spark = stream.sparkSession
    folder = working_folder(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def update_available(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over all data present and read the last row of each key.

    Every batch overwrites its own folder, so a batch that is run again leaves one copy.
    """
    spark = stream.sparkSession
    folder = working_folder(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/data")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("last")).select(*keys, "last.*")
