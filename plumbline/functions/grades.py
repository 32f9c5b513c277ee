"""Severity, effort and integration-pattern tables as literal expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

# Quality weight of a failed check by severity.
QUALITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.1, "INFO": 0.0}
OTHER_QUALITY_WEIGHT = 0.5

# Penalty points by severity, weight for ordering by severity.
SEVERITY_POINTS = {"CRITICAL": 20, "HIGH": 10, "MEDIUM": 5, "LOW": 2, "INFO": 0}
SEVERITY_WEIGHTS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}

# Share of each category in the overall score.
SCORE_WEIGHTS = {
    "schema_inconsistency": 0.30,
    "pipeline_bottleneck": 0.25,
    "middleware_gap": 0.20,
    "data_quality": 0.15,
    "security_concern": 0.10,
}

# Effort level -> (minimum days, maximum days).
EFFORT_DAYS = {
    "TRIVIAL": (0, 1),
    "LOW": (1, 5),
    "MEDIUM": (5, 21),
    "HIGH": (21, 90),
    "CRITICAL": (90, 180),
}
EFFORT_CONFIDENCE = 0.7

# Integration pattern -> (name, description, use cases, min days, max days).
INTEGRATION_PATTERNS = {
    "rest_api": (
        "REST API Gateway",
        "HTTP/REST interface for AI agent queries",
        ["real_time_lookup", "agent_integration"],
        3,
        10,
    ),
    "message_queue": (
        "Message Queue / Event Bus",
        "Async event streaming for AI agent notifications",
        ["event_driven", "async_processing"],
        5,
        15,
    ),
    "etl_pipeline": (
        "ETL/ELT Data Pipeline",
        "Data synchronization between systems",
        ["data_consistency", "unified_data_model"],
        10,
        40,
    ),
    "api_gateway": (
        "Enterprise API Gateway",
        "Centralized API management with auth/rate limiting",
        ["multi_system_access", "security"],
        5,
        20,
    ),
    "data_virtualization": (
        "Data Virtualization Layer",
        "Unified query interface across heterogeneous systems",
        ["unified_data_model", "cross_system_query"],
        15,
        60,
    ),
    "identity_federation": (
        "Identity Federation / SSO",
        "Unified authentication across enterprise systems",
        ["security", "agent_authentication"],
        3,
        15,
    ),
    "semantic_layer": (
        "Business Semantic Layer",
        "Maps technical data models to business concepts",
        ["ai_comprehension", "entity_resolution"],
        10,
        30,
    ),
}


def choose(key: Column, values: dict, default=None) -> Column:
    """``values[key]`` as a CASE expression, ``default`` for other keys and null."""
    expr = None
    for name, value in values.items():
        expr = F.when(key == name, F.lit(value)) if expr is None else expr.when(key == name, F.lit(value))
    return expr.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL .. 3 for LOW, 99 for anything else."""
    return choose(severity, {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}, 99)


def effort_min(level: Column) -> Column:
    return choose(level, {k: v[0] for k, v in EFFORT_DAYS.items()})


def effort_max(level: Column) -> Column:
    return choose(level, {k: v[1] for k, v in EFFORT_DAYS.items()})


def pattern_description(pattern: Column) -> Column:
    return choose(pattern, {k: v[1] for k, v in INTEGRATION_PATTERNS.items()})


def pattern_min_days(pattern: Column) -> Column:
    return choose(pattern, {k: v[3] for k, v in INTEGRATION_PATTERNS.items()})


def pattern_max_days(pattern: Column) -> Column:
    return choose(pattern, {k: v[4] for k, v in INTEGRATION_PATTERNS.items()})


def verdict_for(score: Column) -> Column:
    return F.when(score >= 80, "GO").when(score >= 50, "NOT_YET").otherwise("NOT_READY")


def color_for(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")


def finding_id(*parts: Column) -> Column:
    """Repeatable id of a finding: a hash of the values that identify it."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
