import pytest

from plumbline.operators import gaps, scoring

FINDING = "run_id int, kind string, severity string"
GAP = "run_id int, severity string, blocking boolean, effort_max int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def run_list(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "run_id int")


def systems(spark, run, *types):
    return spark.createDataFrame([(run, t) for t in types], "run_id int, type string")


def kinds(df):
    return [(r.gap_type, r.severity, r.blocking) for r in df.orderBy("run_id", "gap_ord").collect()]


def test_demo_run(spark):
    """Golden G1: three systems, no findings."""
    s = systems(spark, 1, "CRM", "ERP", "CRM")
    found = gaps.middleware_gaps(s)
    assert kinds(found) == [("api_gateway", "HIGH", False), ("semantic_layer", "HIGH", False), ("rest_api", "MEDIUM", False)]
    pipeline = frame(spark, [(1, 2.5, 380.0), (1, 0.5, 180.0)], "run_id int, error_rate_pct double, p95_ms double")
    r = scoring.readiness(run_list(spark, 1), None, pipeline, found).first()
    assert (r.middleware_score, r.overall_score, r.verdict, r.color, r.remediation_weeks) == (85, 97.0, "GO", "green", 12.0)


def test_five_missing_fields(spark):
    """Golden G2."""
    findings = frame(spark, [(1, "missing_field", "HIGH")] * 5, FINDING)
    r = scoring.readiness(run_list(spark, 1), findings).first()
    assert (r.schema_score, r.overall_score, r.verdict) == (50, 85.0, "GO")


def test_missing_fields_and_gaps(spark):
    """Golden G3."""
    findings = frame(spark, [(1, "missing_field", "HIGH")] * 5, FINDING)
    found = gaps.middleware_gaps(systems(spark, 1, "CRM", "ERP"), findings)
    assert kinds(found) == [("etl_pipeline", "HIGH", True), ("semantic_layer", "HIGH", False), ("rest_api", "MEDIUM", False)]
    r = scoring.readiness(run_list(spark, 1), findings, None, found).first()
    assert (r.middleware_score, r.overall_score, r.verdict, r.remediation_weeks) == (60, 77.0, "NOT_YET", 19.0)
    assert (r.blocking_issues, r.critical_issues, r.total_issues) == (1, 0, 8)


def test_blocking_gaps_replace_the_verdict(spark):
    """Golden G10, and the lift of a low score by a single blocking gap."""
    two = frame(spark, [(1, "CRITICAL", True, 10)] * 2, GAP)
    r = scoring.readiness(run_list(spark, 1), None, None, two).first()
    assert (r.middleware_score, r.overall_score, r.verdict) == (10, 82.0, "NOT_READY")
    findings = frame(spark, [(1, "x", "CRITICAL")] * 9, FINDING)
    pipeline = frame(spark, [(1, 50.0, 9000.0)] * 9, "run_id int, error_rate_pct double, p95_ms double")
    one = frame(spark, [(1, "CRITICAL", True, 10)], GAP)
    r = scoring.readiness(run_list(spark, 1), findings, pipeline, one).first()
    assert r.overall_score < 50 and r.verdict == "NOT_YET" and r.color == "red"


def test_runs_without_findings_score_full_marks(spark):
    findings = frame(spark, [(2, "x", "CRITICAL"), (9, "x", "HIGH")], FINDING)
    got = {r.run_id: r for r in scoring.readiness(run_list(spark, 1, 2), findings).collect()}
    assert set(got) == {1, 2}
    assert (got[1].overall_score, got[1].remediation_weeks) == (100.0, None)
    assert got[2].schema_score == 83


def test_quality_and_defaults(spark):
    quality = frame(spark, [(1, "CRITICAL", False), (1, "HIGH", False), (1, "CRITICAL", True), (1, "CRITICAL", None)], "run_id int, severity string, passed boolean")
    unknown = frame(spark, [(1, "HIGH", None, None)], GAP)
    security = run_list(spark, 1)
    r = scoring.readiness(run_list(spark, 1), None, None, unknown, quality, security).first()
    assert (r.data_quality_score, r.security_score, r.middleware_score, r.total_issues) == (70, 90, 95, 5)
    assert r.remediation_weeks == pytest.approx(14 / 5)


def test_weights_can_be_given(spark):
    weights = {"schema_inconsistency": 1, "pipeline_bottleneck": 0, "middleware_gap": 0, "data_quality": 0, "security_concern": 0}
    findings = frame(spark, [(1, "x", "HIGH")], FINDING)
    assert scoring.readiness(run_list(spark, 1), findings, weights=weights).first().overall_score == 90.0


def test_penalty_scorer(spark):
    """Golden G11."""
    findings = frame(spark, [(1, "x", "CRITICAL")], FINDING)
    slow = frame(spark, [(1, "HIGH")], "run_id int, severity string")
    gap = frame(spark, [(1, "CRITICAL")], "run_id int, severity string")
    r = scoring.readiness_penalty(run_list(spark, 1, 2), findings, slow, gap).orderBy("run_id").collect()
    assert [(x.readiness_score, x.verdict) for x in r] == [(87.5, "GO"), (100.0, "GO")]
    odd = frame(spark, [(1, "x", "ODD")] * 100, FINDING)
    assert scoring.readiness_penalty(run_list(spark, 1), odd).first().readiness_score == 0.0


def test_gap_rules(spark):
    s = systems(spark, 1, "CRM", "CRM", "CRM", "CRM", "CRM")
    findings = frame(spark, [(1, "key_mismatch", "CRITICAL")] * 3, FINDING)
    assert kinds(gaps.middleware_gaps(s, findings)) == [("semantic_layer", "CRITICAL", True), ("api_gateway", "HIGH", True)]
    existing = frame(spark, [(1, "semantic_layer"), (1, "api_gateway")], "run_id int, pattern string")
    assert kinds(gaps.middleware_gaps(s, findings, existing)) == []
    assert kinds(gaps.middleware_gaps(systems(spark, 1, None), None, None, run_list(spark, 1, 7))) == [("semantic_layer", "HIGH", False)] * 2


def test_total_effort(spark):
    found = gaps.middleware_gaps(systems(spark, 1, "CRM", "ERP", "CRM"))
    assert tuple(gaps.total_effort(found).first()) == (1, 18, 60)
