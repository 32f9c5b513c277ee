from plumbline.operators import remediation as rem
from plumbline.operators.predicates import gap_view

FINDING = (
    "run_id int, input_ord long, kind string, entity_name string, field_name string, severity string, "
    "remediation_hint string, impact_description string"
)
SLOW = (
    "run_id int, input_ord long, pipeline_name string, system string, bottleneck_type string, severity string, "
    "observed_value double, threshold_value double, unit string, description string"
)
GAP = (
    "run_id int, input_ord long, gap_ord int, gap_id string, gap_type string, source_system string, target_system string, "
    "severity string, blocking boolean, description string, recommended_solution string, effort_min int, effort_max int"
)
ISSUE = "run_id int, input_ord long, severity string, title string"


def inputs(spark):
    return (
        spark.createDataFrame([(1, 0, "key_mismatch", "Contact", "Id", "CRITICAL", "Fix it", "Bad")], FINDING),
        spark.createDataFrame([(1, 0, "sync", "sap", "error_rate", "HIGH", 7.5, 5.0, "%", "Too many errors")], SLOW),
        spark.createDataFrame([(1, 0, 0, "gap_etl_pipeline", "etl_pipeline", "a", "b", "CRITICAL", True, "None.", "Build", 21, 90)], GAP),
        spark.createDataFrame([(1, 3, None, None), (1, 9, "HIGH", "Stale")], ISSUE),
    )


def test_plan_order_and_effort(spark):
    """Golden G12, without and with quality issues."""
    findings, slow, gap, issues = inputs(spark)
    items = rem.plan_items(findings, slow, gap)
    plan = rem.remediation_plan(items).orderBy("recommended_sequence").collect()
    assert [(r.category, r.priority, r.recommended_sequence) for r in plan] == [("schema", 10, 1), ("middleware", 10, 2), ("pipeline", 7, 3)]
    assert [r.title for r in plan] == [
        "Resolve key mismatch for 'Contact'.Id", "Implement etl pipeline between a and b", "Resolve error rate bottleneck in 'sync' on sap",
    ]
    assert plan[0].description == "Fix it"
    assert plan[2].description == "Too many errors (observed 7.5%, threshold 5.0%)"
    e = rem.remediation_effort(items).first()
    assert (e.min_days, e.max_days, e.effort_level, e.confidence) == (32, 140, "CRITICAL", 0.7)
    titles = [r.title for r in rem.remediation_plan(rem.plan_items(findings, slow, gap, issues)).orderBy("recommended_sequence").collect()]
    assert titles[3:] == ["Stale", "Data quality issue #1"]


def test_float_truncation_and_empty_runs(spark):
    """Golden G14: 90 days give 62."""
    items = rem.plan_items(gaps=inputs(spark)[2])
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    got = {r.run_id: (r.min_days, r.max_days, r.effort_level) for r in rem.remediation_effort(items, runs).collect()}
    assert got == {1: (14, 62, "HIGH"), 2: (0, 1, "TRIVIAL")}


def test_empty_hint_falls_back_to_impact(spark):
    df = spark.createDataFrame([(1, 0, "missing_field", "E", None, "ODD", "", "Bad")], FINDING)
    r = rem.schema_items(df).first()
    assert (r.title, r.description, r.priority, r.effort_min_days, r.effort_max_days) == ("Resolve missing field for 'E'", "Bad", 5, 5, 21)


def test_summary_counts(spark):
    findings, slow, gap, issues = inputs(spark)
    r = rem.findings_summary(findings, slow, gap, issues).first()
    assert tuple(r) == (1, 1, 1, 1, 2, 2, 1)
    text = rem.technical_summary(findings, slow, gap, issues).first().technical_summary
    assert text.split("\n") == [
        "=== Technical Readiness Summary ===", "", "Schema Inconsistencies : 1", "  CRITICAL: 1", "Pipeline Bottlenecks   : 1",
        "  HIGH    : 1", "Middleware Gaps        : 1", "  Blocking            : 1", "Data Quality Issues    : 2",
    ]
    parts = {(r.kind, r.severity, r.is_total): r.n for r in rem.severity_breakdown(findings, slow, gap, issues).collect()}
    assert parts["data_quality", "HIGH", False] == 1 and parts["data_quality", None, True] == 2


def test_simple_plan(spark):
    findings = spark.createDataFrame([(1, "CRITICAL"), (1, "CRITICAL"), (1, "HIGH"), (2, "LOW")], "run_id int, severity string")
    gap = inputs(spark)[2]
    rows = rem.simple_plan(findings, gap, include_high=True).orderBy("run_id", "recommended_sequence").collect()
    assert [(r.run_id, r.id, r.recommended_sequence, r.priority) for r in rows] == [
        (1, "rem_gap_etl_pipeline", 1, 9), (1, "rem_schema_critical", 2, 10), (1, "rem_schema_high", 3, 8),
    ]
    assert rows[0].title == "Implement Etl Pipeline"
    assert (rows[1].effort_min_days, rows[1].effort_max_days) == (6, 14)
    assert rem.simple_plan(findings, gap).count() == 2


def test_executive_summary(spark):
    scores = spark.createDataFrame([(1, 77.0, "NOT_YET", 19.0), (2, 100.0, "GO", None)], "run_id int, overall_score double, verdict string, remediation_weeks double")
    summary = spark.createDataFrame(
        [(1, 5, 0, 0, 3, 1)],
        "run_id int, schema_inconsistencies long, critical_schema long, pipeline_bottlenecks long, middleware_gaps long, blocking_gaps long",
    )
    got = {r.run_id: r.executive_summary for r in rem.executive_summary(scores, summary, "May 01, 2024").collect()}
    assert got[1].split("\n") == [
        "**Readiness Assessment: 77% — NOT YET**", "",
        "Your enterprise infrastructure needs targeted improvements before AI deployment can succeed.", "",
        "**Schema Consistency:** 5 inconsistencies found across connected systems.",
        "**Integration Gaps:** 3 missing middleware component(s) identified, with 1 blocking deployment.", "",
        "**Estimated Remediation Timeline:** 19–28 weeks to reach deployment readiness.", "",
        "This assessment was conducted using read-only access to your systems. No data was modified.", "Assessment date: May 01, 2024",
    ]
    assert "Schema Consistency" not in got[2] and "Timeline" not in got[2]


def test_top_issues(spark):
    findings = spark.createDataFrame([(1, n, "HIGH" if n else "LOW", str(n)) for n in range(8)], "run_id int, input_ord int, severity string, impact_description string")
    gap = inputs(spark)[2]
    rows = rem.top_issues(findings, gap).orderBy("issue_type", "rank").collect()
    assert [(r.issue_type, r.detail) for r in rows] == [("Middleware", "None.")] + [("Schema", str(n)) for n in range(1, 6)]


def test_gap_view_defaults(spark):
    df = spark.createDataFrame([(1, None, "rest_api", None, None, None, 3, None)], "run_id int, gap_id string, gap_type string, severity string, blocking boolean, description string, effort_min int, effort_max int")
    assert tuple(gap_view(df).first()) == (1, "unknown", "rest_api", "MEDIUM", False, "", 5, 20, "HTTP/REST interface for AI agent queries")


def test_topics_are_those_of_the_items_and_number_nothing(spark):
    of = inputs(spark)
    topics = rem.plan_topics(*of)
    assert {tuple(r) for r in topics.collect()} == {tuple(r) for r in rem.plan_items(*of).select("run_id", "topic").collect()}
    plan = topics._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "severity" not in plan.split("LogicalRDD")[0]
    findings, slow, gap, issues = of
    assert rem.plan_topics(findings.select("run_id", "entity_name"), slow, gap.select("run_id", "gap_type"), issues.select("run_id")).count() == topics.count()


def test_registered_plan_writes_no_items(spark, sf_dir, monkeypatch):
    """Their hashes are most of their bytes, and the plan shows one of two."""
    from plumbline.plans import queries

    labels = []

    def store(frame, label):
        labels.append((label, frame.columns))
        return frame

    monkeypatch.setattr(queries, "stored", store)
    columns = queries.remediation_plan(spark, sf_dir).columns
    assert "related_gap_ids" in columns and labels
    assert not any("item_id" in of or "related_gap_ids" in of for _, of in labels)
