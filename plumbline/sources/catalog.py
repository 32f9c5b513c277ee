"""Field catalogs of systems.

A catalog row is ``system``, ``system_ord``, ``entity``, ``field``, ``field_ord``,
``type``, ``nullable``, ``pk`` and, where known, ``fk_to``.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("system", T.StringType()),
        T.StructField("system_ord", T.LongType()),
        T.StructField("entity", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("field_ord", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("pk", T.BooleanType()),
        T.StructField("fk_to", T.StringType()),
    ]
)

# The system views read from a relational source.
INFORMATION_SCHEMA = {
    "tables": "SELECT table_schema, table_name, table_type FROM information_schema.tables",
    "columns": (
        "SELECT table_schema, table_name, column_name, data_type, is_nullable, ordinal_position "
        "FROM information_schema.columns"
    ),
    "constraints": (
        "SELECT constraint_name, table_schema, table_name, constraint_type FROM information_schema.table_constraints"
    ),
    "key_columns": (
        "SELECT constraint_name, table_schema, table_name, column_name FROM information_schema.key_column_usage"
    ),
    "referenced_columns": (
        "SELECT constraint_name, table_schema, table_name, column_name "
        "FROM information_schema.constraint_column_usage"
    ),
}


def read_jdbc(spark: SparkSession, query: str, **options: str) -> DataFrame:
    """Result of a query in a relational source; the driver jar is the session's."""
    return spark.read.format("jdbc").option("query", query).options(**options).load()


def read_information_schema(spark: SparkSession, **options: str) -> dict[str, DataFrame]:
    return {name: read_jdbc(spark, query, **options) for name, query in INFORMATION_SCHEMA.items()}


def primary_keys(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Columns of primary-key constraints."""
    keys = ["constraint_name", "table_schema", "table_name"]
    return (
        constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
        .join(key_columns, keys)
        .select("table_schema", "table_name", "column_name")
        .distinct()
        .withColumn("pk", F.lit(True))
    )


def foreign_keys(constraints: DataFrame, key_columns: DataFrame, referenced_columns: DataFrame) -> DataFrame:
    """``table.column`` each foreign-key column refers to; the last constraint by name wins."""
    keys = ["constraint_name", "table_schema"]
    referenced = referenced_columns.select(
        *keys, F.concat_ws(".", "table_name", "column_name").alias("fk_to")
    )
    return (
        constraints.filter(F.col("constraint_type") == "FOREIGN KEY")
        .join(key_columns.select(*keys, "column_name"), keys)
        .join(referenced, keys)
        .groupBy("table_schema", "table_name", "column_name")
        .agg(F.max_by("fk_to", F.struct("constraint_name", "fk_to")).alias("fk_to"))
    )


def catalog_from_information_schema(
    views: dict[str, DataFrame], system: str | None = None, system_ord: int = 0
) -> DataFrame:
    """Catalog of base tables and views with key flags.

    ``system`` names the whole source; without it every schema is a system.
    """
    key = ["table_schema", "table_name", "column_name"]
    columns = views["columns"]
    if "tables" in views:
        listed = views["tables"].filter(F.col("table_type").isin("BASE TABLE", "VIEW"))
        columns = columns.join(listed.select("table_schema", "table_name"), ["table_schema", "table_name"], "left_semi")
    return (
        columns.join(primary_keys(views["constraints"], views["key_columns"]), key, "left")
        .join(foreign_keys(views["constraints"], views["key_columns"], views["referenced_columns"]), key, "left")
        .select(
            (F.lit(system) if system else F.col("table_schema")).alias("system"),
            F.lit(system_ord).cast("long").alias("system_ord"),
            F.col("table_name").alias("entity"),
            F.col("column_name").alias("field"),
            F.col("ordinal_position").cast("int").alias("field_ord"),
            F.col("data_type").alias("type"),
            (F.col("is_nullable") == "YES").alias("nullable"),
            F.coalesce("pk", F.lit(False)).alias("pk"),
            "fk_to",
        )
    )


def upper_case_names(catalog: DataFrame) -> DataFrame:
    """Catalog of a warehouse that folds names to upper case and declares no keys."""
    return (
        catalog.withColumn("entity", F.upper("entity"))
        .withColumn("field", F.upper("field"))
        .withColumn("pk", F.lit(False))
        .withColumn("fk_to", F.lit(None).cast("string"))
    )


def catalog_from_tables(tables: dict[str, DataFrame], system: str, system_ord: int = 0) -> DataFrame:
    """Catalog of tables Spark already sees."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (system, system_ord, name, field.name, position, field.dataType.simpleString(), field.nullable, False, None)
        for name, df in tables.items()
        for position, field in enumerate(df.schema)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def table_sizes(tables: dict[str, DataFrame], system: str) -> DataFrame:
    """Row count of each table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(system).alias("system"), F.lit(name).alias("entity"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def described_catalog(tables: dict[str, DataFrame], system: str, system_ord: int = 0) -> DataFrame:
    """Catalog with the row count of the entity on each row."""
    return catalog_from_tables(tables, system, system_ord).join(table_sizes(tables, system), ["system", "entity"])


def system_size(sizes: DataFrame) -> DataFrame:
    """Entities and rows per system; unknown row counts count as 0."""
    return sizes.groupBy("system").agg(
        F.count(F.lit(1)).alias("entity_count"), F.sum(F.coalesce("row_count", F.lit(0))).alias("total_rows")
    )


def table_stats(sizes: DataFrame) -> DataFrame:
    """Tables by live rows, largest first."""
    return sizes.select(F.col("entity").alias("table_name"), F.col("row_count").alias("live_rows")).orderBy(
        F.col("live_rows").desc(), "table_name"
    )


DESCRIBE_JSON = T.StructType(
    [
        T.StructField("system", T.StringType()),
        T.StructField("system_ord", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("queryable", T.BooleanType()),
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("nillable", T.BooleanType()),
                        T.StructField("idLookup", T.BooleanType()),
                        T.StructField("referenceTo", T.ArrayType(T.StringType())),
                        T.StructField("label", T.StringType()),
                        T.StructField("length", T.IntegerType()),
                        T.StructField("createable", T.BooleanType()),
                        T.StructField("updateable", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)


def catalog_from_describe(objects: DataFrame) -> DataFrame:
    """Catalog of CRM objects from their describe documents (``DESCRIBE_JSON`` columns).

    Objects that cannot be queried are left out; one without described fields keeps a
    row with a null field.
    """
    field = F.col("f")
    return (
        objects.filter("queryable")
        .select("system", "system_ord", F.col("name").alias("entity"), F.posexplode_outer("fields").alias("field_ord", "f"))
        .select(
            "system",
            "system_ord",
            "entity",
            field["name"].alias("field"),
            "field_ord",
            field["type"].alias("type"),
            F.when(field.isNotNull(), F.coalesce(field["nillable"], F.lit(True))).alias("nullable"),
            F.when(field.isNotNull(), F.coalesce(field["idLookup"], F.lit(False)) & (field["type"] == "id")).alias("pk"),
            F.concat(F.get(field["referenceTo"], F.lit(0)), F.lit(".Id")).alias("fk_to"),
            field["label"].alias("label"),
            field["length"].alias("length"),
            F.when(field.isNotNull(), F.coalesce(field["createable"], F.lit(False))).alias("createable"),
            F.when(field.isNotNull(), F.coalesce(field["updateable"], F.lit(False))).alias("updateable"),
        )
    )


def read_describe(spark: SparkSession, path: str) -> DataFrame:
    """Describe documents, one JSON object per line."""
    return spark.read.schema(DESCRIBE_JSON).json(path)


def parse_describe(documents: DataFrame, column: str = "document") -> DataFrame:
    return documents.select(F.from_json(column, DESCRIBE_JSON).alias("o")).select("o.*")
