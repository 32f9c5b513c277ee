"""Whole assessments of a portfolio of runs.

Every input carries ``run_id``; a single run is a portfolio of size one. Findings that
several results read are written once (``stored``) and read back.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.messages import REVIEW_FIELDS
from plumbline.operators import gaps, remediation, requests, schema_exact, schema_fuzzy, scoring
from plumbline.operators.ranking import HASH_BUCKET, number_rows
from plumbline.sources.folders import stored
from plumbline.sources.results import report_documents

_SEPARATOR = "\u0001"


def _keyed(catalog: DataFrame) -> DataFrame:
    """Entities of different runs are different entities."""
    return catalog.withColumn("entity", F.concat_ws(_SEPARATOR, F.col("run_id").cast("string"), "entity")).drop("run_id")


def _unkeyed(findings: DataFrame) -> DataFrame:
    parts = F.split("entity", _SEPARATOR, 2)
    return findings.withColumn("run_id", parts[0].cast("long")).withColumn("entity", parts[1])


def schema_findings(catalog: DataFrame, threshold: float | None = schema_fuzzy.THRESHOLD) -> DataFrame:
    """Inconsistency report of each run, in the layout of the finding tables."""
    compared = stored(schema_fuzzy.compare_fields(_keyed(catalog), threshold, stored), "compared")
    report = _unkeyed(schema_fuzzy.inconsistency_report(compared))
    found = report.select(
        "run_id",
        F.col("entity").alias("entity_name"),
        "source_system",
        "target_system",
        "kind",
        "field_name",
        "severity",
        F.col("detail").alias("impact_description"),
        F.lit(REVIEW_FIELDS).alias("remediation_hint"),
    )
    # A repeatable position; ties between equal hashes are cut off by the text itself.
    position = F.xxhash64("entity_name", "source_system", "target_system", "kind", "impact_description")
    return found.withColumn("input_ord", position)


def exact_findings(catalog: DataFrame, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Findings of the exact-name comparison of each run, in the same layout.

    What is stored are the bare findings; their texts, several times as many bytes, are filled in where they are read.
    """
    bare = store(schema_exact.bare_findings(store(_keyed(catalog), "run_catalog")), "exact_findings")
    return _unkeyed(schema_exact.described(bare)).select(
        "run_id",
        F.col("entity").alias("entity_name"),
        "source_system",
        "target_system",
        F.col("inconsistency_type").alias("kind"),
        "field_name",
        "severity",
        "impact_description",
        "remediation_hint",
        F.xxhash64("entity", "source_system", "target_system", "inconsistency_type", "field_name").alias("input_ord"),
    )


def assess(
    runs: DataFrame,
    catalog: DataFrame,
    systems: DataFrame,
    request_log: DataFrame | None = None,
    existing: DataFrame | None = None,
    quality: DataFrame | None = None,
    threshold: float | None = schema_fuzzy.THRESHOLD,
    weights: dict[str, float] | None = None,
    assessed_on: str = "",
    include_high: bool = False,
) -> dict[str, DataFrame]:
    """Comparison, gaps, request metrics, weighted scores, summary text and short plan.

    Returns ``findings``, ``gaps``, ``pipeline``, ``scores``, ``plan``, ``summary`` and
    ``reports``.
    """
    findings = stored(schema_findings(catalog, threshold), "findings")
    pipeline = None if request_log is None else stored(requests.request_metrics(request_log), "pipeline")
    found_gaps = stored(gaps.middleware_gaps(systems, findings, existing, runs), "gaps")
    scores = stored(scoring.readiness(runs, findings, pipeline, found_gaps, quality, weights=weights), "scores")
    none = findings.limit(0).select("run_id", "severity")
    slow = none if pipeline is None else requests.bottlenecks(pipeline).select("run_id", "severity")
    counts = remediation.findings_summary(findings, slow, found_gaps, none if quality is None else quality)
    critical = findings.groupBy("run_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical_schema"))
    summary = counts.join(critical, "run_id", "left").na.fill(0, ["critical_schema"])
    plan = remediation.simple_plan(findings, found_gaps, include_high)
    sizes = plan.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("effort_min_days").alias("min_days"),
        F.sum("effort_max_days").alias("max_days"),
    )
    return {
        "findings": findings,
        "gaps": found_gaps,
        "pipeline": pipeline,
        "scores": scores,
        "plan": plan,
        "summary": remediation.executive_summary(scores, summary, assessed_on),
        "reports": report_documents(scores, counts, sizes, assessed_on),
    }


def assess_exact(runs: DataFrame, catalog: DataFrame, scenarios: DataFrame | None = None) -> dict[str, DataFrame]:
    """Exact-name comparison scored by penalties, with the full remediation plan.

    Returns ``findings``, ``scores``, ``plan``, ``effort`` and ``summary``.
    """
    findings = exact_findings(catalog)
    scores = scoring.readiness_penalty(runs, findings)
    ordered = number_rows(findings, ["run_id"], "input_ord", name="finding_number", rows_per_bucket=HASH_BUCKET).drop("input_ord")
    items = remediation.plan_items(ordered.withColumnRenamed("finding_number", "input_ord"))
    none = findings.limit(0).select("run_id", "severity", F.lit(False).alias("blocking"))
    counts = remediation.findings_summary(findings, none, none, none)
    return {
        "findings": findings,
        "scores": scores,
        "plan": remediation.remediation_plan(items),
        # Totals need no numbers, so findings are not sorted for them.
        "effort": remediation.remediation_effort(remediation.plan_items(findings), runs),
        "summary": remediation.executive_summary_penalty(scores, counts, scenarios),
    }
