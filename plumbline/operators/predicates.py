"""Filters, guards, validation rules and renaming projections."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grades import pattern_description, severity_rank
from plumbline.functions.messages import REVIEW_FIELDS

# Statements that must not run.
WRITE_KEYWORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "EXEC", "EXECUTE"]

# Allowed range of each scenario setting.
SCENARIO_RANGES = {
    "concurrent_users": (1, 1000),
    "queries_per_minute": (1, 10000),
    "peak_multiplier": (1.0, 10.0),
    "response_time_target_ms": (50, 30000),
}


def is_read_only(query: Column) -> Column:
    """False when the statement starts with a write keyword or has one between spaces."""
    text = F.upper(F.trim(query, F.lit(" \t\n\r\f\v")))
    writes = [F.startswith(text, F.lit(k)) | F.contains(text, F.lit(f" {k} ")) for k in WRITE_KEYWORDS]
    return ~reduce(lambda a, b: a | b, writes)


def is_select(query: Column) -> Column:
    return F.startswith(F.upper(F.trim(query, F.lit(" \t\n\r\f\v"))), F.lit("SELECT"))


def active(systems: DataFrame) -> DataFrame:
    return systems.filter(F.col("status") == "connected")


def requested_entities(catalog: DataFrame, entities: DataFrame) -> DataFrame:
    """Catalog rows of the listed entities; listed entities without rows disappear."""
    return catalog.join(entities.select("entity"), "entity", "left_semi")


def blocking(gaps: DataFrame) -> DataFrame:
    return gaps.filter("blocking")


def critical_counts(findings: DataFrame, bottlenecks: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per run: CRITICAL findings of the three kinds and blocking gaps, in one shuffle."""
    critical = (F.col("severity") == "CRITICAL").cast("int").alias("critical")
    rows = (
        findings.select("run_id", critical, F.lit(0).alias("blocking"))
        .unionByName(bottlenecks.select("run_id", critical, F.lit(0).alias("blocking")))
        .unionByName(gaps.select("run_id", critical, F.col("blocking").cast("int").alias("blocking")))
    )
    return rows.groupBy("run_id").agg(
        F.sum("critical").alias("critical_count"), F.sum("blocking").alias("blocking_count")
    )


def at_least(findings: DataFrame, floor: str, order: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Extension: findings of at least the given severity, most severe first."""
    rank = severity_rank(F.col("severity"))
    listed = findings.filter(rank <= severity_rank(F.lit(floor))).orderBy(rank, *order)
    if offset:
        listed = listed.offset(offset)
    return listed if limit is None else listed.limit(limit)


def validate_scenarios(scenarios: DataFrame) -> DataFrame:
    """Adds ``failed_rules``, the settings out of range, and ``valid``. Null settings pass."""
    failed = F.array_compact(
        F.array(*[F.when(~F.col(name).between(*bounds), F.lit(name)) for name, bounds in SCENARIO_RANGES.items()])
    )
    return scenarios.withColumn("failed_rules", failed).withColumn("valid", F.size("failed_rules") == 0)


def is_valid_score(score: Column) -> Column:
    return score.between(0.0, 100.0)


def unknown_references(requested: DataFrame, key: str, registered: DataFrame, id_column: str) -> DataFrame:
    """Requested ids that are not registered."""
    known = registered.select(F.col(id_column).alias(key))
    return requested.select(key).distinct().join(known, key, "left_anti")


def finding_view(report: DataFrame, hint: str = REVIEW_FIELDS) -> DataFrame:
    """Report rows under their published names, with defaults for missing values."""
    def or_else(name: str, default: str) -> Column:
        value = F.col(name) if name in report.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default))

    return report.select(
        *[c for c in ("run_id",) if c in report.columns],
        or_else("id", "unknown").alias("id"),
        or_else("entity", "unknown").alias("entity_name"),
        or_else("source_system", "").alias("source_system"),
        or_else("target_system", "").alias("target_system"),
        or_else("kind", "").alias("inconsistency_type"),
        or_else("severity", "MEDIUM").alias("severity"),
        or_else("detail", "").alias("impact_description"),
        F.lit(hint).alias("remediation_hint"),
    )


def gap_view(gaps: DataFrame) -> DataFrame:
    """Gap rows under their published names; effort defaults to 5-20 days."""
    whole = F.col("effort_min").isNotNull() & F.col("effort_max").isNotNull()
    return gaps.select(
        "run_id",
        F.coalesce("gap_id", F.lit("unknown")).alias("id"),
        F.coalesce("gap_type", F.lit("")).alias("gap_type"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("blocking", F.lit(False)).alias("blocking"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.when(whole, F.col("effort_min")).otherwise(5).alias("effort_min_days"),
        F.when(whole, F.col("effort_max")).otherwise(20).alias("effort_max_days"),
        F.coalesce(pattern_description(F.col("gap_type")), F.lit("")).alias("recommended_solution"),
    )


def load_plan(scenarios: DataFrame) -> DataFrame:
    """Load-test settings of each scenario."""
    per_minute = F.coalesce("queries_per_minute", F.lit(60))
    peak = F.coalesce("peak_multiplier", F.lit(2.0))
    return scenarios.select(
        "run_id",
        (per_minute / F.lit(60.0) * peak).alias("target_qps"),
        F.least(F.lit(60), F.coalesce("duration_seconds", F.lit(30))).alias("duration_seconds"),
        F.lit(10).alias("ramp_up_seconds"),
        F.coalesce("concurrent_users", F.lit(10)).alias("concurrent_workers"),
    )
