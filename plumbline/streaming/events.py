"""Windowed request metrics, de-duplication, run state and event counts on streams.

Event time is a TIMESTAMP column; a TIMESTAMP_NTZ column has to be cast first.

``delay`` is for live input: events later than that are left out and closed state is dropped. ``delay=None`` is for a
closed backlog: no event is late, however the input is cut into files and batches. Run it in update mode (or, for
``deduplicate``, append mode), which also gives the windows that are still open at the end.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.requests import health, request_metrics
from plumbline.operators.runs import progress_measures


def _watermarked(events: DataFrame, time: str, delay: str | None) -> DataFrame:
    return events.withWatermark(time, delay) if delay else events


def request_windows(
    requests: DataFrame,
    time: str = "event_time",
    window: str = "1 day",
    slide: str | None = None,
    delay: str | None = "1 hour",
    by: list[str] | None = None,
) -> DataFrame:
    """Latency counts of each window, ready to be merged or ranked.

    State holds one row per distinct outcome and latency of the open windows (``WINDOW_KEYS`` and ``by``), and
    requests later than ``delay`` are left out.
    """
    return (
        _watermarked(requests, time, delay)
        .groupBy(F.window(time, window, slide or window).alias("w"), *(by or ["system_name"]), "success", "latency_ms")
        .agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *(by or ["system_name"]),
            "success",
            "latency_ms",
            "n",
            "start_us",
            "end_us",
        )
    )


WINDOW_KEYS = ["window_start", "window_end", "success", "latency_ms"]


def window_metrics(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact request metrics of closed windows from their latency counts."""
    keys = ["window_start", "window_end", *(by or ["system_name"])]
    return health(request_metrics(windows, keys, weight="n"))


def approximate_windows(
    requests: DataFrame, time: str = "event_time", window: str = "1 day", delay: str = "1 hour", by: str = "system_name"
) -> DataFrame:
    """The same with a percentile sketch: small state whatever the number of latencies."""
    latency = F.when(F.col("success"), F.col("latency_ms"))
    return (
        requests.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), by)
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(~F.col("success")).alias("failed_requests"),
            F.percentile_approx(latency, [0.5, 0.95, 0.99], 1000).alias("percentiles"),
            F.max(latency).alias("max_ms"),
        )
    )


def deduplicate(events: DataFrame, key: str = "event_id", time: str = "event_time", delay: str | None = "1 hour") -> DataFrame:
    """Each event once, for events delivered again within ``delay`` (None: at any time)."""
    if delay is None:
        return events.dropDuplicates([key])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_states(changes: DataFrame) -> DataFrame:
    """Current state of each run, for update mode."""
    order = F.struct("changed_at", "version_ord")
    return changes.groupBy("run_id").agg(
        *progress_measures(F.col("status"), F.col("changed_at"), order, F.col("error_message"))
    )


def event_counts(
    events: DataFrame, total: str, time: str = "event_time", window: str = "1 day", delay: str | None = "1 hour"
) -> DataFrame:
    """Events and sum of a payload number per window and event type."""
    return (
        _watermarked(events, time, delay)
        .groupBy(F.window(time, window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("event_count"), F.sum(total).alias("payload_total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "event_count", "payload_total")
    )
