"""Result tables and report documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import fixed
from plumbline.sources.folders import stored

RUN_BUCKETS = 64
ROWS_PER_TASK = 1_000_000


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

# Columns of the persisted tables.
TABLES = {
    "runs": _schema(
        ("run_id", L), ("name", S), ("status", S), ("progress_pct", D), ("error_message", S), ("scenario", S),
        ("report_summary", S), ("created_at", TS), ("started_at", TS), ("completed_at", TS),
    ),
    "connections": _schema(
        ("run_id", L), ("name", S), ("type", S), ("connector_type", S), ("status", S), ("error", S),
        ("metadata", T.MapType(S, S)), ("connected_at", TS),
    ),
    "schema_findings": _schema(
        ("run_id", L), ("input_ord", L), ("entity_name", S), ("source_system", S), ("target_system", S), ("kind", S),
        ("field_name", S), ("severity", S), ("impact_description", S), ("remediation_hint", S),
    ),
    "bottlenecks": _schema(
        ("run_id", L), ("input_ord", L), ("pipeline_name", S), ("system", S), ("bottleneck_type", S),
        ("observed_value", D), ("threshold_value", D), ("unit", S), ("severity", S), ("description", S),
    ),
    "gaps": _schema(
        ("run_id", L), ("gap_ord", I), ("gap_id", S), ("gap_type", S), ("severity", S), ("blocking", B),
        ("description", S), ("effort_min", I), ("effort_max", I),
    ),
    "remediation_items": _schema(
        ("run_id", L), ("item_id", S), ("title", S), ("description", S), ("category", S), ("priority", I),
        ("severity", S), ("effort_min_days", I), ("effort_max_days", I), ("confidence", D),
        ("recommended_sequence", L), ("related_gap_ids", T.ArrayType(S)), ("prerequisites", T.ArrayType(S)),
    ),
}


def run_bucket(buckets: int = RUN_BUCKETS):
    return F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")


def write_results(df: DataFrame, path: str, buckets: int = RUN_BUCKETS, rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> None:
    """Write a result table partitioned by run bucket, replacing only the buckets written.

    Rows are spread by bucket and row hash, the further the more there are, so that one large run is written by many tasks.
    ``rows`` is their number, if it is known.
    """
    if rows is None:  # stored first, so that counting does not run the whole plan twice
        df = stored(df, "results")
        rows = df.count()
    parts = 1 + rows // rows_per_task
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != "run_id"]), F.lit(parts))
    (
        df.withColumn("run_bucket", run_bucket(buckets))
        .repartition("run_bucket", spread)
        .sortWithinPartitions("run_bucket", "run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_bucket")
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str, table: T.StructType, run_id=None, buckets: int = RUN_BUCKETS) -> DataFrame:
    """Read a result table; with a run id only that run's bucket folder is scanned."""
    df = spark.read.schema(T.StructType([*table.fields, T.StructField("run_bucket", I)])).parquet(path)
    if run_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(run_id).cast(table["run_id"].dataType)), F.lit(buckets)).cast("int")
        df = df.filter((F.col("run_bucket") == bucket) & (F.col("run_id") == run_id))
    return df.drop("run_bucket")


def report_documents(scores: DataFrame, summary: DataFrame, plan_sizes: DataFrame, generated_at: str) -> DataFrame:
    """One JSON document per run with score, verdict, counts and plan size."""
    counts = [c for c in summary.columns if c != "run_id"]
    shown = scores.select("run_id", "overall_score", "verdict", "remediation_weeks")
    joined = shown.join(summary, "run_id", "left").na.fill(0, counts).join(plan_sizes, "run_id", "left")
    document = F.struct(
        "run_id",
        F.col("overall_score").alias("readiness_score"),
        "verdict",
        F.struct(*counts).alias("findings_summary"),
        F.coalesce("item_count", F.lit(0)).alias("remediation_items"),
        F.coalesce("min_days", F.lit(0)).alias("total_effort_min_days"),
        F.coalesce("max_days", F.lit(0)).alias("total_effort_max_days"),
        F.coalesce(fixed(F.col("remediation_weeks"), 0), F.lit("TBD")).alias("remediation_weeks"),
        F.lit(generated_at).alias("generated_at"),
    )
    return joined.select("run_id", F.to_json(document).alias("report"))


def write_reports(documents: DataFrame, path: str) -> None:
    """Write report documents as JSON lines."""
    documents.select(F.col("report").alias("value")).write.mode("overwrite").text(path)
