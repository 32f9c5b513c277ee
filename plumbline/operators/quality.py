"""Quality of table contents: completeness, uniqueness, references, formats."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.grades import OTHER_QUALITY_WEIGHT, QUALITY_WEIGHTS
from plumbline.functions.names import is_identifier, is_key
from plumbline.functions.text import percent

COMPLETENESS_GATE = 0.05

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("check_name", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("details", T.StringType()),
        T.StructField("sample_issues", T.ArrayType(T.StringType())),
    ]
)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _result(df: DataFrame, check: str, system: str, table: str) -> DataFrame:
    values = {
        "check_name": F.lit(check),
        "system": F.lit(system),
        "table": F.lit(table),
        "sample_issues": F.array().cast("array<string>"),
    }
    return df.select(*[values.get(f.name, F.col(f.name)).alias(f.name) for f in RESULT_SCHEMA])


def _truthy(value: Column, data_type: T.DataType) -> Column:
    """Values that take part in the duplicate check: not null, zero, false or empty."""
    if isinstance(data_type, T.NumericType):
        return value != 0
    if isinstance(data_type, T.StringType):
        return value != ""
    if isinstance(data_type, T.BooleanType):
        return value
    if isinstance(data_type, T.BinaryType):
        return F.length(value) > 0
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return F.size(value) > 0
    return value.isNotNull()


def null_rates(df: DataFrame, system: str, table: str) -> DataFrame:
    """Share of null or empty values per column, all columns in one pass."""
    blanks = []
    for i, field in enumerate(df.schema):
        blank = _column(field.name).isNull()
        if isinstance(field.dataType, T.StringType):
            blank = blank | (_column(field.name) == "")
        blanks.append(F.count_if(blank).alias(f"blank{i}"))
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *blanks)
    per_column = F.array(
        *[
            F.struct(
                F.lit(i).alias("column_ord"),
                F.lit(field.name).alias("column"),
                F.lit(is_key(field.name)).alias("key_like"),
                F.col(f"blank{i}").alias("null_count"),
            )
            for i, field in enumerate(df.schema)
        ]
    )
    return (
        counts.filter(F.col("row_count") > 0)
        .select("row_count", F.inline(per_column))
        .select(
            F.lit(system).alias("system"),
            F.lit(table).alias("table"),
            "column_ord",
            "column",
            "key_like",
            "row_count",
            "null_count",
            (F.col("null_count") / F.col("row_count")).alias("null_rate"),
        )
    )


def completeness(df: DataFrame, system: str, table: str, gate: float = COMPLETENESS_GATE) -> DataFrame:
    """Columns whose null rate is above ``gate``, graded by rate and kind of column."""
    rate = F.col("null_rate")
    severity = (
        F.when(F.col("key_like"), F.when(rate > 0, "CRITICAL").otherwise("INFO"))
        .when(rate > 0.3, "HIGH")
        .when(rate > 0.1, "MEDIUM")
        .otherwise("INFO")
    )
    graded = (
        null_rates(df, system, table)
        .filter(rate > gate)
        .withColumn("severity", severity)
        .withColumn("passed", rate == 0)
        .withColumn("score", F.lit(1.0) - rate)
        .withColumn("details", F.concat(percent(rate), F.lit(" null rate in "), F.col("column")))
    )
    return _result(graded, "completeness", system, table)


def uniqueness(df: DataFrame, system: str, table: str, limit: int | None = None) -> DataFrame:
    """Duplicate values in the identifier columns; of the first ``limit`` if given.

    One aggregation per column: each reads a single column and combines equal values
    before the shuffle, where several distinct counts in one aggregate would multiply rows.
    """
    identifiers = [f for f in df.schema if is_identifier(f.name)][:limit]
    if not identifiers:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    parts = []
    for field in identifiers:
        value = _column(field.name)
        per_value = (
            df.filter(_truthy(value, field.dataType)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        )
        parts.append(
            per_value.agg(F.sum("n").alias("values"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates")).withColumn(
                "column", F.lit(field.name)
            )
        )
    counted = reduce(DataFrame.unionByName, parts).filter(F.col("duplicates") > 0)
    graded = (
        counted.withColumn("severity", F.lit("CRITICAL"))
        .withColumn("passed", F.lit(False))
        .withColumn("score", F.lit(1.0) - F.col("duplicates") / F.greatest(F.col("values"), F.lit(1)))
        .withColumn(
            "details",
            F.concat(F.col("duplicates").cast("string"), F.lit(" duplicate values in "), F.col("column")),
        )
    )
    return _result(graded, "uniqueness", system, table)


def profile_table(df: DataFrame, system: str, table: str) -> DataFrame:
    """Completeness and uniqueness results of one table."""
    return completeness(df, system, table).unionByName(uniqueness(df, system, table))


def profile_tables(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Results of many tables, keyed by (system, table)."""
    return reduce(DataFrame.unionByName, [profile_table(df, s, t) for (s, t), df in tables.items()])


def overall_quality(results: DataFrame, by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Overall score 0..1 per group; groups without results score 1.0.

    Penalties are summed as counts per severity, so the result does not depend on
    the order in which partitions are added.
    """
    failed = ~F.coalesce(F.col("passed"), F.lit(True))
    counts = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(failed).alias("failed_count"),
        *[F.count_if(failed & (F.col("severity") == s)).alias(f"failed_{s.lower()}") for s in QUALITY_WEIGHTS],
    )
    if groups is not None:
        counts = groups.select(*by).distinct().join(counts, by, "left").na.fill(0)
    graded = F.lit(0)
    penalty = F.lit(0.0)
    for severity, weight in QUALITY_WEIGHTS.items():
        n = F.col(f"failed_{severity.lower()}")
        graded = graded + n
        penalty = penalty + n * F.lit(weight)
    penalty = penalty + (F.col("failed_count") - graded) * F.lit(OTHER_QUALITY_WEIGHT)
    score = F.greatest(F.lit(0.0), F.lit(1.0) - penalty / F.greatest(F.col("result_count"), F.lit(1)))
    return counts.select(
        *by,
        "result_count",
        "failed_count",
        F.when(F.col("failed_count") == 0, F.lit(1.0)).otherwise(score).alias("quality_score"),
    )


def referential_integrity(
    child: DataFrame, foreign_key: str, parent: DataFrame, key: str, system: str, table: str
) -> DataFrame:
    """Rows of ``child`` whose non-null foreign key has no row in ``parent``.

    Child rows are counted per key before the join, so a hot key is one row in it.
    """
    keys = (
        child.filter(_column(foreign_key).isNotNull())
        .groupBy(_column(foreign_key).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = parent.select(_column(key).alias("value")).filter(F.col("value").isNotNull()).distinct().withColumn("known", F.lit(True))
    return (
        keys.join(known, "value", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("checked_rows"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
            F.count_if(F.col("known").isNull()).alias("orphan_keys"),
        )
        .select(
            F.lit("referential_integrity").alias("check_name"),
            F.lit(system).alias("system"),
            F.lit(table).alias("table"),
            F.lit(foreign_key).alias("column"),
            F.lit("HIGH").alias("severity"),
            (F.col("orphan_rows") == 0).alias("passed"),
            "checked_rows",
            "orphan_rows",
            "orphan_keys",
            (F.col("orphan_rows") / F.greatest(F.col("checked_rows"), F.lit(1))).alias("orphan_rate"),
        )
    )


def value_shape(value: Column) -> Column:
    """Runs of letters become ``A`` and runs of digits ``9``; other characters stay."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "A"), "[0-9]+", "9")


def format_consistency(df: DataFrame, columns: list[str], system: str, table: str) -> DataFrame:
    """Share of the most frequent value shape of each text column."""
    parts = []
    for name in columns:
        shapes = (
            df.filter(_column(name).isNotNull() & (_column(name) != ""))
            .groupBy(value_shape(_column(name)).alias("shape"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        parts.append(
            shapes.agg(
                F.sum("n").alias("checked_rows"),
                F.count(F.lit(1)).alias("shape_count"),
                F.max("n").alias("modal_rows"),
                F.min_by("shape", F.struct(-F.col("n"), F.col("shape"))).alias("modal_shape"),
            ).withColumn("column", F.lit(name))
        )
    return reduce(DataFrame.unionByName, parts).filter(F.col("checked_rows") > 0).select(
        F.lit("format_consistency").alias("check_name"),
        F.lit(system).alias("system"),
        F.lit(table).alias("table"),
        "column",
        F.lit("MEDIUM").alias("severity"),
        (F.col("shape_count") == 1).alias("passed"),
        "checked_rows",
        "shape_count",
        "modal_shape",
        (F.col("modal_rows") / F.col("checked_rows")).alias("score"),
    )
