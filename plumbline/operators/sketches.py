"""Approximate uniqueness and latency percentiles from stored sketches that merge without their rows.

One pass over the rows makes a small sketch per group (a run, a system, a day) and column; portfolio levels are merged from
the sketches alone. A distinct count is off by ``1.04 / sqrt(2^LOG_ENTRIES)`` as one standard deviation (1.6 % at 12); a
quantile lies within ``RANK_ERROR`` of the wanted rank with 99 % confidence at the default size. For exact results see
``quality.uniqueness`` and ``requests.request_metrics``.

Defined cases: nulls are no values; a group without values has no sketch, zero distinct values and null percentiles; empty
tables give empty results. Sketches of different sizes merge, at the error of the coarser.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_ENTRIES = 12
DISTINCT_ERROR = 1.04 / 2 ** (LOG_ENTRIES / 2)
QUANTILE_SIZE = 200
RANK_ERROR = 0.0165


def distinct_sketches(df: DataFrame, by: list[str], columns: list[str], log_entries: int = LOG_ENTRIES) -> DataFrame:
    """(by, column, values, sketch): all columns in one pass, one buffer per group, column and task before the shuffle."""
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.col(f"`{c}`")).alias("values"),
            F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(log_entries)).alias("sketch"),
        )
        for c in columns
    ]
    made = df.groupBy(*by).agg(F.array(*parts).alias("parts"))
    return made.select(*by, F.inline("parts"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of a coarser level, from those of a finer one."""
    return sketches.groupBy(*by, "column").agg(F.sum("values").alias("values"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def uniqueness_estimates(sketches: DataFrame) -> DataFrame:
    """Estimated distinct values, and the share of values that are none's duplicate, with three deviations on either side."""
    keys = [c for c in sketches.columns if c not in ("sketch", "values")]
    distinct = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    held = F.greatest(F.col("values"), F.lit(1))
    bound = lambda error: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("distinct") * (1 + error) / held))
    estimated = sketches.withColumn("distinct", F.when(F.col("values") > 0, F.least(distinct, F.col("values"))).otherwise(F.lit(0)))
    return estimated.select(
        *keys, "values", "distinct", bound(0).alias("score"), bound(-3 * DISTINCT_ERROR).alias("score_low"), bound(3 * DISTINCT_ERROR).alias("score_high")
    )


def latency_sketches(requests: DataFrame, by: list[str], size: int = QUANTILE_SIZE) -> DataFrame:
    """(by, total_requests, failed_requests, max_ms, sketch) of the latencies of successful requests."""
    latency = F.when(F.col("success"), F.col("latency_ms").cast("double"))
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        F.max(latency).alias("max_ms"),
        F.kll_sketch_agg_double(latency, F.lit(size)).alias("sketch"),
    )


def merged_latencies(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.sum("total_requests").alias("total_requests"),
        F.sum("failed_requests").alias("failed_requests"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def latency_estimates(sketches: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Counts, error rate and estimated percentiles of every group."""
    shares = shares or {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    some = F.col("total_requests") > F.col("failed_requests")
    found = [F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in shares.items()]
    rate = (F.col("failed_requests") / F.col("total_requests") * 100).alias("error_rate_pct")
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], rate, *found)


def all_levels(sketches: DataFrame, merge, levels: list[list[str]]) -> DataFrame:
    """The sketches of several levels in one table; a key that a level leaves out is null there."""
    keys = sorted({k for level in levels for k in level})
    kinds = dict(sketches.dtypes)
    tables = [merge(sketches, level).withColumns({k: F.lit(None).cast(kinds[k]) for k in keys if k not in level}) for level in levels]
    return reduce(DataFrame.unionByName, tables)
