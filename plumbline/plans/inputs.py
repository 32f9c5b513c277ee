"""Operator inputs derived from the test tables.

The SQL is plain enough for Spark and for the engine that checks the results; a
``{table}`` placeholder stands for a table. Each input reads whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.grades import pattern_description, pattern_max_days, pattern_min_days
from plumbline.operators.requests import KEYS, bottlenecks, normalise_outcomes, request_metrics
from plumbline.sources.folders import stored

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DIRTY_CUSTOMER = """
SELECT CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 50 < 2 THEN c_custkey - c_custkey % 2 ELSE c_custkey END AS customer_id,
       CASE WHEN c_custkey % 40 = 1 THEN NULL ELSE c_custkey END AS account_key,
       CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       c_acctbal AS acctbal
FROM {customer}
"""

RAW_REQUESTS = """
SELECT event_id AS request_id, user_id AS run_id, concat('sys_', CAST(event_id % 5 AS STRING)) AS system_name,
       event_type AS query_type, ts AS start_ts, value * 20 AS elapsed_ms,
       NOT (event_type = 'view' AND value < 1) AS result,
       CASE WHEN event_type = 'error' AND value < 12 THEN concat('backend error ', props) END AS exception
FROM {events}
"""

FINDINGS = """
SELECT o_orderkey AS input_ord, o_custkey AS run_id, concat('entity_', CAST(o_orderkey % 7 AS STRING)) AS entity_name,
       'sys_a' AS source_system, 'sys_b' AS target_system, concat('f_', CAST(o_orderkey % 11 AS STRING)) AS field_name,
       CASE o_orderstatus WHEN 'F' THEN 'missing_field' WHEN 'O' THEN 'type_mismatch' ELSE 'key_mismatch' END AS kind,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN 'LOW' ELSE 'INFO' END AS severity,
       concat('Impact of ', o_orderpriority, ' order') AS impact_description,
       CASE WHEN o_totalprice > 200000 THEN 'Align both definitions' WHEN o_totalprice > 100000 THEN '' END AS remediation_hint
FROM {orders}
"""

GAP_ROWS = """
SELECT o_custkey AS run_id, l_linenumber AS gap_ord, concat('gap_', CAST(l_linenumber AS STRING)) AS gap_id,
       CASE l_linenumber % 7 WHEN 0 THEN 'rest_api' WHEN 1 THEN 'message_queue' WHEN 2 THEN 'etl_pipeline' WHEN 3 THEN 'api_gateway' WHEN 4 THEN 'data_virtualization' WHEN 5 THEN 'identity_federation' ELSE 'semantic_layer' END AS gap_type,
       CASE WHEN max(l_quantity) >= 50 THEN 'CRITICAL' WHEN max(l_quantity) >= 45 THEN 'HIGH' WHEN max(l_quantity) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN 1 ELSE 0 END) = 1 AS blocking,
       concat('Line ', CAST(l_linenumber AS STRING), ' has no integration') AS description,
       'sys_a' AS source_system, 'sys_b' AS target_system
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_linenumber
"""

# Foreign keys of the entities of FINDINGS; a few runs have cycles.
ENTITY_REFERENCES = """
SELECT DISTINCT o_custkey AS run_id, concat('entity_', CAST(o_orderkey % 7 AS STRING)) AS entity, concat('entity_', CAST(l_suppkey % 7 AS STRING)) AS parent
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE l_suppkey % 7 < o_orderkey % 7 AND l_linenumber = 1 OR l_suppkey % 7 > o_orderkey % 7 AND l_quantity >= 50 AND l_linenumber = 2
"""

QUALITY = """
SELECT o_custkey AS run_id, l_linenumber AS input_ord, concat('col_', CAST(l_linenumber AS STRING)) AS column_name,
       CASE WHEN max(l_returnflag) = 'R' AND max(l_linestatus) = 'O' THEN 'CRITICAL' WHEN max(l_returnflag) = 'R' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       min(l_quantity) > 3 AS passed
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_linenumber
"""

SYSTEMS = """
SELECT CAST(floor(c_custkey / 1500) AS BIGINT) * 700 + CASE WHEN c_custkey % 1500 < 1200 THEN c_custkey % 1500 % 700 WHEN c_custkey % 1500 < 1350 THEN c_custkey % 50 ELSE 100 + c_custkey % 150 END AS run_id, c_name AS name,
       CASE c_nationkey % 6 WHEN 0 THEN 'ERP' WHEN 1 THEN 'CRM' WHEN 2 THEN 'DATA_WAREHOUSE' WHEN 3 THEN 'DATABASE' WHEN 4 THEN 'API' ELSE 'MESSAGE_QUEUE' END AS type,
       CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_custkey % 9 = 0 THEN 'disconnected' ELSE 'connected' END AS status,
       CASE WHEN c_acctbal < 0 THEN 'connection refused' END AS error
FROM {customer}
"""

# A table per order of the customer that a connection stands for.
CONNECTION_TABLES = """
SELECT CAST(floor(c_custkey / 1500) AS BIGINT) * 700 + CASE WHEN c_custkey % 1500 < 1200 THEN c_custkey % 1500 % 700 WHEN c_custkey % 1500 < 1350 THEN c_custkey % 50 ELSE 100 + c_custkey % 150 END AS run_id,
       c_name AS name, concat('table_', CAST(o_orderkey AS STRING)) AS table_name
FROM {customer} JOIN {orders} ON o_custkey = c_custkey
"""

EXISTING = """
SELECT DISTINCT p_partkey % 700 AS run_id,
       CASE p_size % 7 WHEN 0 THEN 'rest_api' WHEN 1 THEN 'message_queue' WHEN 2 THEN 'etl_pipeline' WHEN 3 THEN 'api_gateway' WHEN 4 THEN 'data_virtualization' WHEN 5 THEN 'identity_federation' ELSE 'semantic_layer' END AS pattern
FROM {part}
"""

SCENARIOS = """
SELECT p_partkey AS run_id, p_name AS name, CAST(p_size * 25 AS INT) AS concurrent_users,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey * 7 AS INT) END AS queries_per_minute,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 4 END AS peak_multiplier,
       CAST(p_size * 10 AS INT) AS response_time_target_ms,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS INT) + 20 END AS duration_seconds
FROM {part}
"""

RUN_CHANGES = """
SELECT o_custkey AS run_id, o_orderkey AS version_ord, o_orderdate AS changed_at,
       CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN concat('error ', o_orderpriority) END AS error_message
FROM {orders}
"""

STATEMENTS = """
SELECT event_id AS stmt_id, user_id,
       CASE event_type WHEN 'click' THEN concat('  select * from t where k = ', CAST(user_id AS STRING))
            WHEN 'signup' THEN 'Insert into t values (1)'
            WHEN 'error' THEN 'SELECT 1;DROP TABLE t'
            WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'CREATED_AT lookup' ELSE 'WITH x AS (SELECT 1) DELETE FROM t' END
            ELSE 'MERGE INTO t USING s ON 1=1' END AS query
FROM {events}
"""

# Field catalog of six systems: an entity per part, a field per distinct quantity class
# sold by the suppliers of a system; naming style and types drift between systems.
CATALOG = """
SELECT concat('system_', CAST(s AS STRING)) AS system, s AS system_ord, concat('entity_', CAST(e AS STRING)) AS entity,
       CASE WHEN f = 0 THEN CASE WHEN s % 3 = 1 THEN 'Id' ELSE 'id' END
            WHEN f = 6 THEN CASE WHEN s % 3 = 1 THEN 'CustomerId' ELSE 'customer_id' END
            WHEN s % 3 = 1 THEN concat('BillingField', CAST(f AS STRING))
            WHEN s % 3 = 2 AND f % 6 = 5 THEN concat('extra_', CAST(f * 10 + s AS STRING))
            ELSE concat('billing_field', CAST(f AS STRING)) END AS field,
       f AS field_ord,
       CASE (f + CASE WHEN s % 4 = 3 AND f % 9 = 4 THEN 1 ELSE 0 END) % 5
            WHEN 0 THEN CASE WHEN s % 2 = 0 THEN 'varchar(18)' ELSE 'nvarchar(40)' END
            WHEN 1 THEN CASE WHEN s % 2 = 0 THEN 'integer' ELSE 'bigint' END
            WHEN 2 THEN CASE s WHEN 0 THEN 'decimal' WHEN 1 THEN 'numeric(15,2)' ELSE 'numeric' END
            WHEN 3 THEN CASE WHEN s % 2 = 0 THEN 'timestamp' ELSE 'date' END
            ELSE CASE WHEN s < 3 THEN 'boolean' ELSE '' END END AS type,
       f > 0 AS nullable, f = 0 AS pk
FROM (SELECT DISTINCT l_suppkey % 6 AS s, l_partkey AS e, CAST(l_quantity AS INT) % 12 AS f FROM {lineitem}) g
"""

# Systems that name the same things in their own ways: 100 parts to a system, an entity per name and kind of part, a field
# per row of lineitem.
NAMED_ENTITIES = """
SELECT concat('system_', CAST(s AS STRING)) AS system, s AS system_ord,
       CASE s % 3 WHEN 0 THEN concat(adjective, '_', noun, '_', kind)
                  WHEN 1 THEN concat(upper(substring(kind, 1, 1)), substring(kind, 2), upper(substring(noun, 1, 1)), substring(noun, 2),
                                     upper(substring(adjective, 1, 1)), substring(adjective, 2))
                  ELSE concat(noun, ' ', kind, '-', adjective) END AS entity,
       CASE f WHEN 0 THEN 'id' WHEN 1 THEN 'created_at' WHEN 2 THEN 'status' WHEN 3 THEN 'total_price' WHEN 4 THEN 'name'
              ELSE concat(CASE WHEN f < 12 THEN noun ELSE concat(adjective, '_', noun) END, CASE WHEN s % 2 = 0 THEN '_field_' ELSE ' Field ' END, CAST(f AS STRING)) END AS field,
       min(f) AS field_ord,
       min(CASE f % 5 WHEN 0 THEN 'varchar(40)' WHEN 1 THEN CASE WHEN s % 2 = 0 THEN 'timestamp' ELSE 'date' END WHEN 2 THEN 'integer'
                      WHEN 3 THEN 'decimal' ELSE CASE WHEN f > 30 THEN '' ELSE 'blob' END END) AS type,
       f > 0 AS nullable, f = 0 AS pk, CAST(sum(quantity) AS BIGINT) AS row_part
FROM (SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS s, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun,
             lower(p_type) AS kind, CAST((l_orderkey * 7 + l_suppkey) % 40 AS BIGINT) AS f, CAST(l_quantity AS BIGINT) AS quantity
      FROM {part} p JOIN {lineitem} l ON l_partkey = p_partkey) g
GROUP BY s, adjective, noun, kind, f
"""

CATALOG_SYSTEMS = """
SELECT DISTINCT concat('system_', CAST(s_suppkey % 6 AS STRING)) AS name,
       CASE WHEN s_suppkey % 6 = 4 THEN 'failed' ELSE 'connected' END AS status
FROM {supplier}
"""

WANTED_ENTITIES = """
SELECT concat('entity_', CAST(p_partkey AS STRING)) AS entity FROM {part} WHERE p_size > 20
"""

# The same catalog as twenty entities per run, and the systems each run connects.
RUN_CATALOG = """
SELECT CAST(floor(CAST(substring(entity, 8) AS BIGINT) / 20) AS BIGINT) AS run_id, system, system_ord, entity, field, field_ord, type, nullable, pk
FROM {catalog}
"""

RUN_SYSTEMS = """
SELECT DISTINCT run_id, system AS name,
       CASE system_ord WHEN 0 THEN 'ERP' WHEN 1 THEN 'CRM' WHEN 2 THEN 'DATA_WAREHOUSE' ELSE 'DATABASE' END AS type
FROM (SELECT CAST(floor(CAST(substring(entity, 8) AS BIGINT) / 20) AS BIGINT) AS run_id, system, system_ord FROM {catalog}) c
"""

# Constraint views of a relational source with one schema per system of the catalog.
CONSTRAINTS = """
SELECT CASE WHEN pk THEN concat('pk_', entity) ELSE concat('fk_', entity, '_', CAST(field_ord AS STRING)) END AS constraint_name,
       system AS table_schema, entity AS table_name,
       CASE WHEN pk THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS constraint_type
FROM {catalog} WHERE pk OR field_ord IN (5, 6, 7)
UNION ALL
SELECT concat('fk_', entity, '_b', CAST(field_ord AS STRING)) AS constraint_name, system AS table_schema, entity AS table_name,
       'FOREIGN KEY' AS constraint_type
FROM {catalog} WHERE field_ord = 7
UNION ALL
SELECT concat('uq_', entity) AS constraint_name, system AS table_schema, entity AS table_name, 'UNIQUE' AS constraint_type
FROM {catalog} WHERE field_ord = 8
"""

KEY_COLUMNS = """
SELECT CASE WHEN pk THEN concat('pk_', entity) ELSE concat('fk_', entity, '_', CAST(field_ord AS STRING)) END AS constraint_name,
       system AS table_schema, entity AS table_name, field AS column_name
FROM {catalog} WHERE pk OR field_ord IN (5, 6, 7)
UNION ALL
SELECT concat('fk_', entity, '_b', CAST(field_ord AS STRING)) AS constraint_name, system AS table_schema, entity AS table_name,
       field AS column_name
FROM {catalog} WHERE field_ord = 7
UNION ALL
SELECT concat('uq_', entity) AS constraint_name, system AS table_schema, entity AS table_name, field AS column_name
FROM {catalog} WHERE field_ord = 8
"""

REFERENCED_COLUMNS = """
SELECT concat('fk_', entity, '_', CAST(field_ord AS STRING)) AS constraint_name, system AS table_schema,
       concat('parent_', CAST(field_ord AS STRING)) AS table_name, 'id' AS column_name
FROM {catalog} WHERE field_ord IN (5, 6, 7)
UNION ALL
SELECT concat('fk_', entity, '_b', CAST(field_ord AS STRING)) AS constraint_name, system AS table_schema,
       'parent_b' AS table_name, 'code' AS column_name
FROM {catalog} WHERE field_ord = 7
"""

INFORMATION_COLUMNS = """
SELECT system AS table_schema, entity AS table_name, field AS column_name, type AS data_type,
       CASE WHEN nullable THEN 'YES' ELSE 'NO' END AS is_nullable, field_ord AS ordinal_position
FROM {catalog}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in TABLE_NAMES}


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {name: table(spark, sf_dir, name) for name in TABLE_NAMES if "{" + name + "}" in sql}
    if "{catalog}" in sql:
        used["catalog"] = catalog(spark, sf_dir)
    return spark.sql(sql, **used)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived field catalog, written once because the comparisons read it several times."""
    return stored(derive(spark, sf_dir, CATALOG), "catalog")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_outcomes(derive(spark, sf_dir, RAW_REQUESTS))


def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_metrics(requests(spark, sf_dir), KEYS)


def number_bottlenecks(metrics: DataFrame) -> DataFrame:
    """Bottlenecks numbered by system and kind inside their run."""
    system_ord = F.substring("system_name", 5, 10).cast("long")
    return bottlenecks(metrics).withColumn("input_ord", system_ord * 2 + F.col("bottleneck_ord"))


def pipeline_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_bottlenecks(pipeline_metrics(spark, sf_dir))


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with the effort and solution of their pattern."""
    kind = F.col("gap_type")
    return (
        derive(spark, sf_dir, GAP_ROWS)
        .withColumn("effort_min", pattern_min_days(kind))
        .withColumn("effort_max", pattern_max_days(kind))
        .withColumn("recommended_solution", pattern_description(kind))
        .withColumn("input_ord", F.col("gap_ord").cast("long"))
    )


def describe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Describe documents of the catalog's entities, one JSON text each.

    Objects with one field cannot be queried, and those with two come without fields.
    """
    field = F.struct(
        F.col("field_ord").alias("ord"),
        F.col("field").alias("name"),
        F.when(F.col("pk"), "id").otherwise(F.col("type")).alias("type"),
        F.when(F.col("field_ord") != 3, F.col("nullable")).alias("nillable"),
        F.col("pk").alias("idLookup"),
        F.when(F.col("field_ord") == 6, F.array(F.lit("Account"), F.lit("Contact"))).otherwise(F.array().cast("array<string>")).alias("referenceTo"),
        F.when(F.col("field_ord") != 2, F.concat(F.lit("Label of "), "field")).alias("label"),
        F.when(F.col("field_ord") % 2 == 0, F.col("field_ord") * 10 + 20).alias("length"),
        F.when(F.col("field_ord") % 3 != 0, F.col("field_ord") % 3 == 1).alias("createable"),
        F.when(F.col("field_ord") != 4, ~F.col("pk")).alias("updateable"),
    )
    n = F.count(F.lit(1))
    return (
        catalog(spark, sf_dir)
        .groupBy("system", "system_ord", "entity")
        .agg(F.array_sort(F.collect_list(field)).alias("all_fields"), n.alias("n"))
        .select(
            F.to_json(
                F.struct(
                    "system",
                    "system_ord",
                    F.col("entity").alias("name"),
                    (F.col("n") > 1).alias("queryable"),
                    F.when(F.col("n") == 2, F.slice("all_fields", 1, 0)).otherwise(F.col("all_fields")).alias("fields"),
                )
            ).alias("document")
        )
    )


def vocabulary_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the words of all benchmark texts: four systems, two entities, a field per word."""
    return _words_of(table(spark, sf_dir, "benchmark"), "item_id")


def document_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all document texts: the load of the bench, too large for check SQL."""
    return _words_of(table(spark, sf_dir, "documents"), "doc_id")


def _words_of(texts: DataFrame, key: str) -> DataFrame:
    item = F.col(key)
    words = texts.select(
        key, F.posexplode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("p", "field")
    )
    return (
        words.filter("field <> ''")
        .groupBy(
            F.concat(F.lit("system_"), (item % 4).cast("string")).alias("system"),
            (item % 4).cast("long").alias("system_ord"),
            F.concat(F.lit("domain_"), (F.floor(item / 4) % 2).cast("string")).alias("entity"),
            "field",
        )
        .agg(F.min(item * 100000 + F.col("p") + 1).alias("field_ord"))
        .select("system", "system_ord", "entity", "field", "field_ord", F.lit("varchar").alias("type"), F.lit(True).alias("nullable"), F.lit(False).alias("pk"))
    )
