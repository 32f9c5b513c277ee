"""Integration gaps of each run, and their effort."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import messages
from plumbline.functions.grades import INTEGRATION_PATTERNS, finding_id, severity_rank
from plumbline.functions.text import fill

RULES = ["api_gateway", "etl_pipeline", "semantic_layer", "rest_api"]


def _facts(systems: DataFrame, findings: DataFrame | None, existing: DataFrame | None, runs: DataFrame | None) -> DataFrame:
    """One row per run with everything the rules look at; one shuffle for all inputs."""
    measures = ["listed", "system_count", "erp", "crm", "finding_count", "key_mismatches", *[f"has_{r}" for r in RULES]]

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("run_id", *[values.get(m, F.lit(0)).cast("long").alias(m) for m in measures])

    listed = F.lit(1)
    parts = [
        part(systems, system_count=F.lit(1), erp=F.col("type") == "ERP", crm=F.col("type") == "CRM", listed=listed if runs is None else F.lit(0))
    ]
    if runs is not None:
        parts.append(part(runs, listed=listed))
    if findings is not None:
        parts.append(part(findings, finding_count=F.lit(1), key_mismatches=F.col("kind") == "key_mismatch"))
    if existing is not None:
        parts.append(part(existing, **{f"has_{r}": F.col("pattern") == r for r in RULES}))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    # An unknown type or pattern is null and counts as no.
    facts = rows.groupBy("run_id").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    return facts.filter(F.col("listed") > 0)


def middleware_gaps(
    systems: DataFrame,
    findings: DataFrame | None = None,
    existing: DataFrame | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Missing integration components of each run, most severe first.

    ``systems`` has ``run_id`` and ``type``; ``findings`` has ``run_id`` and ``kind``;
    ``existing`` has ``run_id`` and ``pattern``. Runs are those of ``systems`` unless a
    list is given.
    """
    n = F.col("system_count")
    key_trouble = F.col("key_mismatches") > 0

    def gap(pattern: str, needed: Column, severity: Column, blocks: Column, text: Column) -> Column:
        low, high = INTEGRATION_PATTERNS[pattern][3:5]
        return F.when(
            needed & (F.col(f"has_{pattern}") == 0),
            F.struct(
                severity_rank(severity).alias("severity_rank"),
                F.when(blocks, 0).otherwise(1).alias("not_blocking"),
                F.lit(RULES.index(pattern)).alias("rule_ord"),
                F.lit(f"gap_{pattern}").alias("gap_id"),
                F.lit(pattern).alias("gap_type"),
                severity.alias("severity"),
                blocks.alias("blocking"),
                text.alias("description"),
                F.lit(low).alias("effort_min"),
                F.lit(high).alias("effort_max"),
            ),
        )

    # At most four gaps per run, so they are ordered inside the row.
    gaps = F.array_sort(
        F.array_compact(
            F.array(
                gap(
                    "api_gateway", n > 2, F.lit("HIGH"), n > 4,
                    fill(messages.NO_API_GATEWAY, systems=n),
                ),
                gap(
                    "etl_pipeline", F.col("finding_count") > 3, F.lit("HIGH"), F.lit(True),
                    F.lit(messages.NO_ETL_PIPELINE),
                ),
                gap(
                    "semantic_layer", F.lit(True), F.when(key_trouble, "CRITICAL").otherwise("HIGH"), key_trouble,
                    F.lit(messages.NO_SEMANTIC_LAYER),
                ),
                gap(
                    "rest_api", (F.col("erp") > 0) & (F.col("crm") > 0), F.lit("MEDIUM"), F.lit(False),
                    F.lit(messages.NO_REST_API),
                ),
            )
        )
    )
    return (
        _facts(systems, findings, existing, runs)
        .select("run_id", F.posexplode(gaps).alias("gap_ord", "gap"))
        .select(
            "run_id",
            "gap_ord",
            "gap.gap_id",
            "gap.gap_type",
            "gap.severity",
            "gap.blocking",
            "gap.description",
            "gap.effort_min",
            "gap.effort_max",
            finding_id(F.col("run_id"), F.col("gap.gap_id")).alias("finding_id"),
        )
    )


def total_effort(gaps: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Days per run; zeros for listed ``runs`` without gaps."""
    rows = gaps.select("run_id", F.col("effort_min").cast("long").alias("low"), F.col("effort_max").cast("long").alias("high"))
    if runs is not None:
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(runs.select("run_id", zero.alias("low"), zero.alias("high")))
    return rows.groupBy("run_id").agg(F.sum("low").alias("effort_min_days"), F.sum("high").alias("effort_max_days"))
