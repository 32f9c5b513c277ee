"""Readiness scores and verdicts per run.

Each scorer turns every finding row into a few counts, unions them with the run list
and groups once: one shuffle of partial sums per scorer, and runs without findings
keep their row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grades import (
    SCORE_WEIGHTS,
    SEVERITY_POINTS,
    choose,
    color_for,
    verdict_for,
)
from plumbline.functions.text import rounded


def _tally(runs: DataFrame, parts: list[tuple[DataFrame | None, dict[str, Column]]]) -> DataFrame:
    names = [name for _, measures in parts for name in measures]
    rows = [runs.select("run_id", *[F.lit(0).cast("long").alias(n) for n in names], F.lit(1).alias("listed"))]
    for df, measures in parts:
        if df is not None:
            columns = [measures.get(n, F.lit(0)).cast("long").alias(n) for n in names]
            rows.append(df.select("run_id", *columns, F.lit(0).alias("listed")))
    counted = (
        reduce(DataFrame.unionByName, rows)
        .groupBy("run_id")
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.max("listed").alias("listed"))
    )
    return counted.filter(F.col("listed") == 1).drop("listed")


def _is(severity: str) -> Column:
    return F.col("severity") == severity


def subscores(
    runs: DataFrame,
    findings: DataFrame | None = None,
    pipeline: DataFrame | None = None,
    gaps: DataFrame | None = None,
    quality: DataFrame | None = None,
    security: DataFrame | None = None,
) -> DataFrame:
    """The five category scores and the counts behind them."""
    failed = ~F.coalesce(F.col("passed"), F.lit(True))
    blocking = F.coalesce(F.col("blocking"), F.lit(False))
    tally = _tally(
        runs,
        [
            (findings, {"schema_all": F.lit(1), "schema_critical": _is("CRITICAL"), "schema_high": _is("HIGH")}),
            (pipeline, {"slow_errors": F.col("error_rate_pct") > 5, "slow_latency": F.col("p95_ms") > 1000}),
            (
                gaps,
                {
                    "gap_all": F.lit(1),
                    "gap_blocking": blocking,
                    "gap_critical": _is("CRITICAL"),
                    "gap_days": F.coalesce(F.col("effort_max"), F.lit(14)),
                },
            ),
            (quality, {"dq_all": F.lit(1), "dq_failed": failed, "dq_critical": failed & _is("CRITICAL")}),
            (security, {"security_all": F.lit(1)}),
        ],
    )

    def score(penalty: Column) -> Column:
        return F.greatest(F.lit(0), 100 - penalty)

    c = F.col
    return (
        tally.withColumn("schema_score", score(c("schema_critical") * 15 + c("schema_high") * 8 + c("schema_all") * 2))
        .withColumn("pipeline_score", score(c("slow_errors") * 20 + c("slow_latency") * 10))
        .withColumn("middleware_score", score(c("gap_blocking") * 25 + c("gap_critical") * 15 + c("gap_all") * 5))
        .withColumn("data_quality_score", score(c("dq_critical") * 20 + c("dq_failed") * 5))
        .withColumn("security_score", score(c("security_all") * 10))
    )


def readiness(
    runs: DataFrame,
    findings: DataFrame | None = None,
    pipeline: DataFrame | None = None,
    gaps: DataFrame | None = None,
    quality: DataFrame | None = None,
    security: DataFrame | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Weighted overall score, verdict, remediation weeks and counters per run.

    Thresholds use the unrounded score. Any blocking gap replaces the verdict: one
    gives NOT_YET, two or more NOT_READY.
    """
    w = {k: F.lit(float(v)) for k, v in (weights or SCORE_WEIGHTS).items()}
    c = F.col
    overall = (
        c("schema_score") * w["schema_inconsistency"]
        + c("pipeline_score") * w["pipeline_bottleneck"]
        + c("middleware_score") * w["middleware_gap"]
        + c("data_quality_score") * w["data_quality"]
        + c("security_score") * w["security_concern"]
    )
    days = c("gap_days") + c("schema_critical") * 7 + c("schema_high") * 3
    verdict = (
        F.when(c("gap_blocking") >= 2, "NOT_READY").when(c("gap_blocking") == 1, "NOT_YET").otherwise(verdict_for(c("overall")))
    )
    return (
        subscores(runs, findings, pipeline, gaps, quality, security)
        .withColumn("overall", overall)
        .withColumn("overall_score", rounded(c("overall"), 1))
        .select(
            "run_id",
            "schema_score",
            "pipeline_score",
            "middleware_score",
            "data_quality_score",
            "security_score",
            "overall_score",
            verdict.alias("verdict"),
            color_for(c("overall_score")).alias("color"),
            c("gap_blocking").alias("blocking_issues"),
            (c("schema_critical") + c("gap_critical") + c("dq_critical")).alias("critical_issues"),
            (c("schema_all") + c("gap_all") + c("dq_all")).alias("total_issues"),
            F.when(days > 0, days / F.lit(5.0)).alias("remediation_weeks"),
        )
    )


def readiness_penalty(
    runs: DataFrame,
    findings: DataFrame | None = None,
    bottlenecks: DataFrame | None = None,
    gaps: DataFrame | None = None,
    quality_issues: DataFrame | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Second scorer: weighted severity points off 100, plain thresholds."""
    w = {k: F.lit(float(v)) for k, v in (weights or SCORE_WEIGHTS).items()}
    points = choose(F.col("severity"), SEVERITY_POINTS, 5)
    tally = _tally(
        runs,
        [
            (findings, {"schema_penalty": points}),
            (bottlenecks, {"pipeline_penalty": points}),
            (gaps, {"middleware_penalty": points}),
            (quality_issues, {"quality_penalty": F.lit(3)}),
        ],
    )
    total = (
        F.col("schema_penalty") * w["schema_inconsistency"]
        + F.col("pipeline_penalty") * w["pipeline_bottleneck"]
        + F.col("middleware_penalty") * w["middleware_gap"]
        + F.col("quality_penalty") * w["data_quality"]
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - total))
    return tally.withColumn("readiness_score", score).withColumn("verdict", verdict_for(F.col("readiness_score")))


def readiness_three_part(
    runs: DataFrame, schema: DataFrame, pipeline: DataFrame, gaps: DataFrame, scores: DataFrame
) -> DataFrame:
    """Extension, third scorer: .40 schema, .35 pipeline, .25 middleware.

    ``scores`` has the three category scores per run; ten points off per critical
    finding, three at most, and any critical finding makes a run NOT_READY.
    """
    tally = _tally(
        runs,
        [
            (schema, {"schema_critical": _is("CRITICAL")}),
            (pipeline, {"pipeline_critical": _is("CRITICAL")}),
            (gaps, {"gap_critical": _is("CRITICAL")}),
        ],
    )
    critical = F.col("schema_critical") + F.col("pipeline_critical") + F.col("gap_critical")
    base = (
        F.col("schema_score") * F.lit(0.40) + F.col("pipeline_score") * F.lit(0.35) + F.col("middleware_score") * F.lit(0.25)
    )
    score = F.greatest(F.lit(0.0), base - F.least(critical, F.lit(3)) * F.lit(10.0))
    return (
        tally.join(scores.select("run_id", "schema_score", "pipeline_score", "middleware_score"), "run_id")
        .select("run_id", critical.alias("critical_count"), score.alias("readiness_score"))
        .withColumn(
            "verdict", F.when(F.col("critical_count") > 0, "NOT_READY").otherwise(verdict_for(F.col("readiness_score")))
        )
    )
