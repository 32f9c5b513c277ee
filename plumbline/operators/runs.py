"""Run and connection tables: upserts, look-ups, cascading deletes, progress."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import truncated

# Progress percentage of each lifecycle state.
PROGRESS = {"pending": 0.0, "running": 0.0, "analyzing": 20.0, "reporting": 80.0, "completed": 100.0}


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``current`` with ``changes`` applied: per key the row that comes last in ``order``."""
    return latest_by(current.unionByName(changes), keys, order)


def find_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def newest_first(df: DataFrame, created: str, tiebreak: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(F.col(created).desc(), F.col(tiebreak).desc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def children_of(df: DataFrame, run_id, created: str) -> DataFrame:
    return df.filter(F.col("run_id") == run_id).orderBy(created)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Rows of each table that survive deleting the given ``run_id`` values."""
    ids = deleted.select("run_id").distinct()
    return {name: df.join(ids, "run_id", "left_anti") for name, df in tables.items()}


def surviving_counts(tables: dict[str, DataFrame], deleted: DataFrame) -> DataFrame:
    counted = None
    for name, df in cascade_delete(tables, deleted).items():
        one = df.agg(F.count(F.lit(1)).alias("surviving_rows")).select(F.lit(name).alias("table_name"), "surviving_rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def progress_measures(status: Column, at: Column, order: Column, error: Column) -> list[Column]:
    """Aggregates that fold status changes into a run's current state."""
    terminal = status.isin("completed", "failed")
    known_error = F.coalesce(error, F.lit("")) != ""
    return [
        F.max_by(status, order).alias("status"),
        # A failed run keeps the progress it had reached.
        F.max_by(
            F.when(status == "failed", F.lit(None).cast("double")).otherwise(_progress(status)),
            F.when(status != "failed", order),
        ).alias("progress_pct"),
        F.min(F.when(status == "running", at)).alias("started_at"),
        F.max(F.when(terminal, at)).alias("completed_at"),
        F.max_by(F.when(known_error, error), F.when(known_error, order)).alias("error_message"),
    ]


def _progress(status: Column) -> Column:
    expr = None
    for name, value in PROGRESS.items():
        expr = F.when(status == name, F.lit(value)) if expr is None else expr.when(status == name, F.lit(value))
    return expr


def run_progress(changes: DataFrame) -> DataFrame:
    """Current state of each run from its status changes.

    ``changes`` has ``run_id``, ``status``, ``changed_at``, ``version_ord`` (order among
    equal times) and ``error_message``. The start is the first ``running``, the end the
    last terminal state, and an empty error never overwrites one.
    """
    order = F.struct("changed_at", "version_ord")
    return changes.groupBy("run_id").agg(
        *progress_measures(F.col("status"), F.col("changed_at"), order, F.col("error_message"))
    )


# States in the order that a run goes through them; the last two end it.
LIFECYCLE = ["pending", "running", "analyzing", "reporting", "completed", "failed"]
TERMINAL_STATES = ["completed", "failed"]


def run_lifecycles(changes: DataFrame) -> DataFrame:
    """Current state of each run when illegal changes are rejected, and how many were.

    A run may only move forward, may skip states, may fail from any state, and ends with ``completed`` or ``failed``. A change
    is legal exactly if it is the first of its state and no first change of a later state came before it, so the earliest
    change of each state and a count decide everything: partial results merge in any order, also on streams, and state is
    a row of ``len(LIFECYCLE)`` entries however long a run's history is. Changes of unknown states are rejected.
    """
    place = F.struct("changed_at", "version_ord")
    first = {name: F.min(F.when(F.col("status") == name, place)).alias(name) for name in LIFECYCLE}
    runs = changes.groupBy("run_id").agg(*first.values(), F.count(F.lit(1)).alias("changes"))
    end = F.least(*TERMINAL_STATES)
    order = [*[name for name in LIFECYCLE if name not in TERMINAL_STATES], "end"]
    runs = runs.withColumn("end", end)
    legal = {}
    for k, name in enumerate(order):
        later = [F.col(c) for c in order[k + 1 :]]
        before = F.lit(True) if not later else F.coalesce(F.col(name) < (F.least(*later) if len(later) > 1 else later[0]), F.lit(True))
        legal[name] = F.col(name).isNotNull() & before
    accepted = sum((F.when(x, 1).otherwise(0) for x in legal.values()), F.lit(0)).cast("long")
    ended = F.when(F.col("failed") == F.col("end"), "failed").otherwise("completed")
    state = F.coalesce(*[F.when(legal[name], ended if name == "end" else F.lit(name)) for name in reversed(order)])
    since = F.coalesce(*[F.when(legal[name], F.col(name)) for name in reversed(order)])
    return runs.select(
        "run_id", state.alias("status"), since["changed_at"].alias("changed_at"), accepted.alias("accepted"), (F.col("changes") - accepted).alias("rejected")
    )


def latest_progress(changes: DataFrame, ttl_seconds: int = 86400) -> DataFrame:
    """Latest entry of each run that is not older than the limit, counted from the newest entry."""
    newest = changes.select(F.max("changed_at")).scalar()
    last = latest_by(changes, ["run_id"], ["changed_at", "version_ord"])
    return last.filter(F.col("changed_at") > newest - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def pack_run(runs: DataFrame) -> DataFrame:
    """Run rows with scenario and report as JSON text, the summary cut to 2000 characters."""
    return runs.withColumn(
        "scenario",
        F.to_json(
            F.struct("name", "concurrent_users", "queries_per_minute", "peak_multiplier", "response_time_target_ms", "use_case")
        ),
    ).withColumn(
        "report_summary",
        F.when(
            F.col("score").isNotNull(),
            F.to_json(
                F.struct("score", "verdict", truncated(F.coalesce("executive_summary", F.lit("")), 2000).alias("executive_summary"))
            ),
        ),
    )


SCENARIO_JSON = (
    "name string, concurrent_users int, queries_per_minute int, peak_multiplier double, "
    "response_time_target_ms int, use_case string"
)
REPORT_JSON = "score double, verdict string, executive_summary string"


def unpack_run(packed: DataFrame) -> DataFrame:
    """Settings read back from JSON, with the defaults used on read."""
    s = F.from_json("scenario", SCENARIO_JSON)
    r = F.from_json("report_summary", REPORT_JSON)
    return packed.select(
        "run_id",
        F.coalesce(s["name"], F.lit("")).alias("name"),
        F.coalesce(s["concurrent_users"], F.lit(10)).alias("concurrent_users"),
        F.coalesce(s["queries_per_minute"], F.lit(60)).alias("queries_per_minute"),
        F.coalesce(s["peak_multiplier"], F.lit(2.0)).alias("peak_multiplier"),
        F.coalesce(s["response_time_target_ms"], F.lit(500)).alias("response_time_target_ms"),
        F.coalesce(s["use_case"], F.lit("")).alias("use_case"),
        r["score"].alias("score"),
        r["verdict"].alias("verdict"),
        F.coalesce(r["executive_summary"], F.lit("")).alias("executive_summary"),
    )


def create_defaults(scenarios: DataFrame) -> DataFrame:
    """Settings of a new run: the query rate defaults to 100 here, to 60 on read."""
    return scenarios.withColumn("queries_per_minute", F.coalesce("queries_per_minute", F.lit(100))).withColumn(
        "peak_multiplier", F.coalesce("peak_multiplier", F.lit(2.0))
    )


def runs_by_status(runs: DataFrame) -> DataFrame:
    """Extension: number of runs per status."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("run_count"))
