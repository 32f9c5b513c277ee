"""Request logs: outcomes, rates, exact percentiles, health and bottlenecks.

A request row has the group columns (``run_id``, ``system_name``), ``start_us`` and
``end_us`` (epoch microseconds), ``success``, ``latency_ms`` and ``error``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import spaced, truncated
from plumbline.operators.ranking import join_on_keys, magnitude_bucket, ranked_values

KEYS = ["run_id", "system_name"]
ERROR_LENGTH = 100


def normalise_outcomes(raw: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """Turn measured calls into request rows.

    ``raw`` has ``start_ts``, ``elapsed_ms``, ``result`` (the call's own answer) and
    ``exception``. A call over the limit failed with ``timeout`` and the limit as its
    latency; a call that raised failed with the first 100 characters of its error.
    """
    timed_out = F.col("elapsed_ms") > timeout_ms
    raised = F.col("exception").isNotNull()
    start_us = F.unix_micros(F.col("start_ts").cast("timestamp"))
    return (
        raw.withColumn("start_us", start_us)
        .withColumn("end_us", start_us + F.floor(F.col("elapsed_ms") * 1000.0))
        .withColumn("latency_ms", F.when(timed_out, F.lit(float(timeout_ms))).otherwise(F.col("elapsed_ms")))
        .withColumn("success", ~timed_out & ~raised & F.coalesce(F.col("result").cast("boolean"), F.lit(False)))
        .withColumn(
            "error",
            F.when(timed_out, "timeout").when(raised, truncated(F.col("exception"), ERROR_LENGTH)),
        )
        .drop("elapsed_ms", "result", "exception", "start_ts")
    )


def _histogram(requests: DataFrame, by: list[str], weight: str) -> DataFrame:
    ok = F.col("success")
    n = F.col(weight)
    return requests.groupBy(*by, F.when(ok, magnitude_bucket(F.col("latency_ms"))).alias("bucket")).agg(
        F.sum(n).alias("requests"),
        F.sum(F.when(ok, n).otherwise(0)).alias("n"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.max(F.when(ok, F.col("latency_ms"))).alias("max_ms"),
    )


def request_counts(requests: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Total, successful and failed requests per group."""
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("success")).alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
    )


def request_metrics(requests: DataFrame, by: list[str] = KEYS, weight: str | None = None) -> DataFrame:
    """Counts, rates and exact percentiles per group.

    The median is the mean of the two middle latencies; p95 and p99 are the sorted
    latency at position ``min(floor(n * p), n - 1)``, counted from 0. Latencies are
    those of successful requests. ``weight`` names a column with the number of equal
    requests a row stands for.
    """
    if weight is None:
        weight = "weight"
        requests = requests.withColumn(weight, F.lit(1).cast("long"))
    histogram = _histogram(requests, by, weight)
    totals = histogram.groupBy(*by).agg(
        F.sum("requests").alias("total_requests"),
        F.sum("n").alias("successful_requests"),
        ((F.max("end_us") - F.min("start_us")) / 1000000.0).alias("duration_s"),
        F.max("max_ms").alias("max_ms"),
    )
    total = F.col("total")

    def at_share(p: float) -> Column:
        return F.least(F.floor(total * F.lit(p)), total - 1)

    ranks = ranked_values(
        requests.filter("success"),
        histogram.filter(F.col("bucket").isNotNull()).select(*by, "bucket", "n"),
        by,
        "latency_ms",
        weight,
        {
            "lower": F.floor((total - 1) / 2),
            "upper": F.floor(total / 2),
            "p95": at_share(0.95),
            "p99": at_share(0.99),
        },
    )
    failed = F.col("total_requests") - F.col("successful_requests")
    zero = F.lit(0.0)
    return join_on_keys(totals, ranks, by, "left").select(
        *by,
        "total_requests",
        "successful_requests",
        failed.alias("failed_requests"),
        "duration_s",
        (F.col("total_requests") / F.greatest(F.col("duration_s"), F.lit(0.001))).alias("actual_qps"),
        (failed / F.col("total_requests") * 100).alias("error_rate_pct"),
        F.coalesce((F.col("lower") + F.col("upper")) / 2, zero).alias("p50_ms"),
        F.coalesce("p95", zero).alias("p95_ms"),
        F.coalesce("p99", zero).alias("p99_ms"),
        F.coalesce("max_ms", zero).alias("max_ms"),
    )


def approximate_percentiles(requests: DataFrame, by: list[str] = KEYS, accuracy: int = 10000) -> DataFrame:
    """One-pass sketch of the same percentiles, for dashboards over very large logs."""
    latency = F.when(F.col("success"), F.col("latency_ms"))
    picked = F.percentile_approx(latency, [0.5, 0.95, 0.99], accuracy)
    return requests.groupBy(*by).agg(picked.alias("p")).select(
        *by,
        *[F.coalesce(F.col("p")[i], F.lit(0.0)).alias(name) for i, name in enumerate(["p50_ms", "p95_ms", "p99_ms"])],
    )


def _healthy() -> Column:
    return (F.col("error_rate_pct") < 5) & (F.col("p95_ms") < 1000)


def health(metrics: DataFrame) -> DataFrame:
    """Adds ``is_healthy`` and ``overall_health``."""
    return metrics.withColumn("is_healthy", _healthy()).withColumn(
        "overall_health", F.when(_healthy(), "HEALTHY").otherwise("DEGRADED")
    )


def bottlenecks(
    metrics: DataFrame, by: list[str] = KEYS, system: str = "system_name", pipeline_name: str = "requests"
) -> DataFrame:
    """At most two rows per group: a high error rate and a high 95th percentile."""

    def graded(value: str, kind: str, unit: str, critical: float, high: float, order: int) -> Column:
        observed = F.col(value)
        severity = F.when(observed >= critical, "CRITICAL").otherwise("HIGH")
        threshold = F.when(observed >= critical, F.lit(critical)).otherwise(F.lit(high))
        return F.when(
            observed >= high,
            F.struct(
                F.lit(order).alias("bottleneck_ord"),
                F.lit(kind).alias("bottleneck_type"),
                severity.alias("severity"),
                observed.alias("observed_value"),
                threshold.alias("threshold_value"),
                F.lit(unit).alias("unit"),
            ),
        )

    found = F.array_compact(
        F.array(
            graded("error_rate_pct", "error_rate", "%", 10.0, 5.0, 0),
            graded("p95_ms", "latency_p95", "ms", 3000.0, 1000.0, 1),
        )
    )
    return (
        metrics.select(*by, F.inline(found))
        .withColumn("system", F.col(system))
        .withColumn("pipeline_name", F.lit(pipeline_name))
        .withColumn("description", F.concat(spaced(F.col("bottleneck_type")), F.lit(" is above its limit")))
    )


def breaking_points(metrics: DataFrame, by: list[str] = KEYS, phase: str = "phase", factor: float = 3.0) -> DataFrame:
    """Extension: the first load phase that breaks each group, and its highest safe rate.

    ``metrics`` has one row per group and phase. A phase breaks when its p95 is above
    ``factor`` times that of the first phase or more than 5 % of its requests failed;
    the safe rate is that of the last phase with a p95 below the limit.
    """
    baseline = metrics.groupBy(*by).agg(F.min_by("p95_ms", phase).alias("baseline_p95_ms"))
    limit = F.col("baseline_p95_ms") * F.lit(factor)
    broken = (F.col("p95_ms") > limit) | (F.col("error_rate_pct") > 5)
    safe = F.col("p95_ms") < limit
    return (
        metrics.join(baseline, by)
        .groupBy(*by, "baseline_p95_ms")
        .agg(
            F.min(F.when(broken, F.col(phase))).alias("breaking_phase"),
            F.max_by(F.when(safe, F.col("actual_qps")), F.when(safe, F.col(phase))).alias("max_safe_qps"),
        )
    )


def connection_details(connections: DataFrame, tables: DataFrame, by: str = "run_id", name: str = "name") -> DataFrame:
    """A row per connection: type, health, latency, error, and its number of tables.

    ``connections`` has ``type``, ``status``, ``error`` and may have ``latency_ms``; ``tables`` has ``by`` and ``name``. The
    tables of a system that is not connected are unknown (null); a connected one without tables has none (0).
    """
    connected = F.coalesce(F.col("status") == "connected", F.lit(False))
    latency = F.col("latency_ms") if "latency_ms" in connections.columns else F.lit(None)
    counted = tables.groupBy(by, name).agg(F.count(F.lit(1)).alias("counted"))
    return connections.join(counted, [by, name], "left").select(
        by,
        name,
        F.col("type").alias("connector_type"),
        connected.alias("healthy"),
        latency.cast("double").alias("latency_ms"),
        "error",
        F.when(connected, F.coalesce("counted", F.lit(0))).alias("tables"),
    )


def connection_summary(connections: DataFrame, tables: DataFrame | None = None, by: str = "run_id") -> DataFrame:
    """Per run: connections by state and success rate, with table counts when given.

    ``connections`` has ``status`` and ``error``; ``tables`` has ``by`` and a row per table.
    """
    connected = F.col("status") == "connected"
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    summary = connections.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(connected).alias("healthy"),
        F.count_if(failed).alias("failed"),
        F.count_if(~connected & ~failed).alias("pending"),
    )
    summary = summary.withColumn("success_rate", F.col("healthy") / F.col("total"))
    if tables is not None:
        counted = tables.groupBy(by).agg(F.count(F.lit(1)).alias("table_count"))
        summary = summary.join(counted, by, "left")
    return summary
