import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import predicates, requests, runs
from plumbline.sources import catalog as cat
from plumbline.sources import folders, reads, results

T0 = datetime(2024, 1, 1)
CHANGE = "run_id int, version_ord int, changed_at timestamp, status string, error_message string"


def changes(spark, rows):
    return spark.createDataFrame([(r, i, T0 + timedelta(hours=h), s, e) for i, (r, h, s, e) in enumerate(rows)], CHANGE)


def test_progress_fold(spark):
    df = changes(spark, [(1, 0, "pending", None), (1, 1, "running", None), (1, 2, "running", None), (1, 3, "reporting", None), (1, 4, "failed", "boom"), (2, 0, "running", ""), (2, 5, "completed", "")])
    got = {r.run_id: r for r in runs.run_progress(df).collect()}
    assert (got[1].status, got[1].progress_pct, got[1].error_message) == ("failed", 80.0, "boom")
    assert (got[1].started_at, got[1].completed_at) == (T0 + timedelta(hours=1), T0 + timedelta(hours=4))
    assert (got[2].status, got[2].progress_pct, got[2].error_message) == ("completed", 100.0, None)


def test_progress_expires(spark):
    df = changes(spark, [(1, 0, "running", None), (2, 30, "running", None), (2, 31, "reporting", None), (3, 48, "running", None)])
    assert {(r.run_id, r.status) for r in runs.latest_progress(df).collect()} == {(2, "reporting"), (3, "running")}


def test_upsert_keeps_nulls_of_the_last_row(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, note string")
    new = spark.createDataFrame([(2, 2, None), (3, 1, "c")], "id int, v int, note string")
    rows = {tuple(r) for r in runs.upsert_latest(old, new, ["id"], ["v"]).collect()}
    assert rows == {(1, 1, "a"), (2, 2, None), (3, 1, "c")}


def test_listing_and_cascade(spark):
    df = changes(spark, [(1, 0, "running", None), (2, 2, "running", None), (3, 1, "running", None)])
    assert [r.run_id for r in runs.newest_first(df, "changed_at", "version_ord", 2).collect()] == [2, 3]
    assert [r.run_id for r in runs.newest_first(df, "changed_at", "version_ord", 2, 1).collect()] == [3, 1]
    left = runs.cascade_delete({"a": df, "b": df}, df.filter("run_id = 2"))
    assert {name: sorted(r.run_id for r in t.collect()) for name, t in left.items()} == {"a": [1, 3], "b": [1, 3]}


def test_json_defaults(spark):
    rows = [(1, "n", None, None, None, None, None, 81.0, "GO", "x" * 3000), (2, "m", 5, 100, 3.0, 50, "u", None, None, None)]
    df = spark.createDataFrame(
        rows, "run_id int, name string, concurrent_users int, queries_per_minute int, peak_multiplier double, "
        "response_time_target_ms int, use_case string, score double, verdict string, executive_summary string",
    )
    got = {r.run_id: r for r in runs.unpack_run(runs.pack_run(df)).collect()}
    assert (got[1].concurrent_users, got[1].queries_per_minute, got[1].peak_multiplier, got[1].response_time_target_ms) == (10, 60, 2.0, 500)
    assert len(got[1].executive_summary) == 2000 and got[2].score is None and got[2].use_case == "u"
    assert runs.create_defaults(df).filter("run_id = 1").first().queries_per_minute == 100


@pytest.mark.parametrize(
    "query,allowed",
    [
        ("select 1", True), ("  DROP TABLE t", False), ("CREATED_AT lookup", False), ("SELECT 1;DROP TABLE t", True),
        ("SELECT 1\nDELETE\n", True), ("with x as (select 1) delete from t", False), ("MERGE INTO t", True), ("\n\tupdate t", False),
    ],
)
def test_read_only_guard(spark, query, allowed):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(predicates.is_read_only(F.col("q")).alias("ok")).first().ok is allowed
    if not allowed:
        with pytest.raises(reads.WriteBlocked):
            reads.read_query(spark, query)


def test_scenario_rules(spark):
    df = spark.createDataFrame([(0, 60, 2.0, 500), (1000, 10000, 10.0, 30000), (5, None, 11.0, 49)], "concurrent_users int, queries_per_minute int, peak_multiplier double, response_time_target_ms int")
    rows = predicates.validate_scenarios(df).collect()
    assert [r.failed_rules for r in rows] == [["concurrent_users"], [], ["peak_multiplier", "response_time_target_ms"]]


def test_severity_floor(spark):
    df = spark.createDataFrame([("LOW", 1), ("HIGH", 2), ("CRITICAL", 3), ("HIGH", 0)], "severity string, n int")
    assert [r.n for r in predicates.at_least(df, "HIGH", ["n"]).collect()] == [3, 0, 2]
    assert [r.n for r in predicates.at_least(df, "HIGH", ["n"], 1, 1).collect()] == [0]


def test_information_schema(spark):
    views = {
        "tables": spark.createDataFrame([("p", "orders", "BASE TABLE"), ("p", "tmp", "LOCAL TEMPORARY")], "table_schema string, table_name string, table_type string"),
        "columns": spark.createDataFrame([("p", "orders", "id", "integer", "NO", 1), ("p", "orders", "cust", "integer", "YES", 2), ("p", "tmp", "x", "text", "YES", 1)], "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"),
        "constraints": spark.createDataFrame([("pk", "p", "orders", "PRIMARY KEY"), ("fk1", "p", "orders", "FOREIGN KEY"), ("fk2", "p", "orders", "FOREIGN KEY")], "constraint_name string, table_schema string, table_name string, constraint_type string"),
        "key_columns": spark.createDataFrame([("pk", "p", "orders", "id"), ("fk1", "p", "orders", "cust"), ("fk2", "p", "orders", "cust")], "constraint_name string, table_schema string, table_name string, column_name string"),
        "referenced_columns": spark.createDataFrame([("fk1", "p", "customer", "id"), ("fk2", "p", "party", "id")], "constraint_name string, table_schema string, table_name string, column_name string"),
    }
    rows = {r.field: (r.nullable, r.pk, r.fk_to) for r in cat.catalog_from_information_schema(views, "pg").collect()}
    assert rows == {"id": (False, True, None), "cust": (True, False, "party.id")}


def test_describe_documents(spark, tmp_path):
    docs = [
        {"system": "sf", "system_ord": 0, "name": "Account", "queryable": True, "fields": [
            {"name": "Id", "type": "id", "nillable": False, "idLookup": True, "referenceTo": []},
            {"name": "OwnerId", "type": "reference", "idLookup": True, "referenceTo": ["User", "Group"]}]},
        {"system": "sf", "system_ord": 0, "name": "Hidden", "queryable": False, "fields": []},
        {"system": "sf", "system_ord": 0, "name": "Broken", "queryable": True, "fields": []},
    ]
    path = tmp_path / "d.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    rows = {(r.entity, r.field): (r.nullable, r.pk, r.fk_to) for r in cat.catalog_from_describe(cat.read_describe(spark, str(path))).collect()}
    assert rows == {("Account", "Id"): (False, True, None), ("Account", "OwnerId"): (True, False, "User.Id"), ("Broken", None): (None, None, None)}


def test_tables_and_sizes(spark):
    tables = {"a": spark.range(3), "b": spark.createDataFrame([(1, [0.5])], "id int, v array<float>")}
    assert [(r.entity, r.field, r.type) for r in cat.catalog_from_tables(tables, "lake").orderBy("entity", "field_ord").collect()] == [
        ("a", "id", "bigint"), ("b", "id", "int"), ("b", "v", "array<float>"),
    ]
    assert tuple(cat.system_size(cat.table_sizes(tables, "lake")).first()) == ("lake", 2, 4)
    assert [r.table_name for r in cat.table_stats(cat.table_sizes(tables, "lake")).collect()] == ["a", "b"]
    assert reads.without_envelope(spark.createDataFrame([(1, 2)], "attributes int, x int")).columns == ["x"]


def test_result_tables_replace_only_their_buckets(spark):
    path = folders.working_folder(spark, "gaps")
    table = results.TABLES["gaps"]
    row = lambda run, d: (run, 0, "gap_x", "rest_api", "HIGH", False, d, 3, 10)
    results.write_results(spark.createDataFrame([row(n, "old") for n in range(40)], table), path, 8)
    results.write_results(spark.createDataFrame([row(5, "new")], table), path, 8)
    assert results.read_results(spark, path, table, 5, 8).first().description == "new"
    kept = results.read_results(spark, path, table, None, 8)
    assert kept.filter("description = 'new'").count() == 1 and kept.count() > 20
    plan = results.read_results(spark, path, table, 5, 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_bucket" in plan


def test_audit_export(spark):
    path = folders.working_folder(spark, "audit")
    reads.export_audit(spark.range(3), path + "/j")
    reads.export_audit(spark.range(3), path + "/c", "csv")
    assert spark.read.json(path + "/j").count() == spark.read.csv(path + "/c", header=True).count() == 3
    with pytest.raises(ValueError):
        reads.export_audit(spark.range(1), path, "xml")


def test_working_folder_follows_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert folders.working_folder(spark, "x").startswith(base)


def test_report_documents(spark):
    scores = spark.createDataFrame([(1, 77.0, "NOT_YET", 19.0), (2, 100.0, "GO", None)], "run_id int, overall_score double, verdict string, remediation_weeks double")
    summary = spark.createDataFrame([(1, 5, 2)], "run_id int, schema_inconsistencies long, middleware_gaps long")
    sizes = spark.createDataFrame([(1, 3, 10, 40)], "run_id int, item_count long, min_days long, max_days long")
    path = folders.working_folder(spark, "reports")
    results.write_reports(results.report_documents(scores, summary, sizes, "2024-05-01"), path)
    got = {d["run_id"]: d for d in (json.loads(r.value) for r in spark.read.text(path).collect())}
    assert got[1] == {
        "run_id": 1, "readiness_score": 77.0, "verdict": "NOT_YET", "findings_summary": {"schema_inconsistencies": 5, "middleware_gaps": 2},
        "remediation_items": 3, "total_effort_min_days": 10, "total_effort_max_days": 40, "remediation_weeks": "19", "generated_at": "2024-05-01",
    }
    assert (got[2]["remediation_weeks"], got[2]["findings_summary"]["middleware_gaps"]) == ("TBD", 0)


def test_conditions_and_columns_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = reads.filtered_scan(orders, [("o_orderstatus", "in", ["F"]), ("o_totalprice", ">=", 1000.0), ("o_custkey", "is", "known")], ["o_orderkey"])
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.split("\n") if line.startswith("PushedFilters"))
    assert all(x in pushed for x in ("GreaterThanOrEqual(o_totalprice,1000.0)", "IsNotNull(o_custkey)", "o_orderstatus")), pushed
    assert "o_orderdate" not in plan


def test_filters_of_unknown_kinds_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "`a.b` int, s string")
    assert [r["a.b"] for r in reads.filtered_scan(rows, [("s", "is", "null")], ["a.b"]).collect()] == [2]
    assert [r["a.b"] for r in reads.filtered_scan(rows, [("a.b", "<", 2), ("s", "starts", "a")], ["a.b"]).collect()] == [1]
    assert reads.filtered_scan(rows, [], ["s"]).count() == 3
    for wrong in ([("x", "=", 1)], [("s", "like", "%")], [("s", "is", "x")]):
        with pytest.raises(ValueError):
            reads.filtered_scan(rows, wrong, ["s"])
    with pytest.raises(ValueError):
        reads.filtered_scan(rows, [], ["x"])


def test_connections_are_listed_with_their_tables(spark):
    kinds = "run_id int, name string, type string, status string, error string, latency_ms double"
    connections = spark.createDataFrame([(1, "a", "ERP", "connected", None, 3.5), (1, "b", "CRM", "failed", "x", None), (2, "a", "API", "connected", None, None)], kinds)
    tables = spark.createDataFrame([(1, "a", "t"), (1, "a", "u"), (1, "b", "v")], "run_id int, name string, table_name string")
    got = {(r.run_id, r.name): (r.connector_type, r.healthy, r.latency_ms, r.error, r.tables) for r in requests.connection_details(connections, tables).collect()}
    assert got == {(1, "a"): ("ERP", True, 3.5, None, 2), (1, "b"): ("CRM", False, None, "x", None), (2, "a"): ("API", True, None, None, 0)}
