import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.operators import runs
from plumbline.operators.requests import request_metrics
from plumbline.operators.runs import run_progress
from plumbline.sources.folders import working_folder
from plumbline.streaming import events, stateful
from plumbline.streaming.tables import append_available, parquet_stream, update_available

T0 = datetime(2024, 1, 1)
LOG = "event_id int, event_time timestamp, system_name string, success boolean, latency_ms double, start_us long, end_us long"


def written(spark, batches, schema):
    """A folder with one file per batch, read one file at a time."""
    folder = working_folder(spark, "stream_input")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{number}")
    frame = spark.read.option("recursiveFileLookup", True).parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    return frame, stream


def requests_between(first, last):
    return [(i, T0 + timedelta(minutes=10 * i), f"s{i % 2}", i % 7 != 0, float(i % 13), i * 10, i * 10 + 5) for i in range(first, last)]


def test_windows_equal_the_batch_result(spark):
    frame, stream = written(spark, [requests_between(0, 100), requests_between(100, 200)], LOG)
    closed = events.window_metrics(append_available(events.request_windows(stream, window="6 hours", delay="1 hour"), "w"))
    day = F.window("event_time", "6 hours")
    batch = request_metrics(frame.withColumn("w", day).withColumn("window_start", F.col("w.start")), ["window_start", "system_name"])
    limit = frame.agg(F.max("event_time")).first()[0] - timedelta(hours=1)
    batch = batch.filter(F.col("window_start") + F.expr("INTERVAL 6 HOURS") <= F.lit(limit))
    names = ["window_start", "system_name", "total_requests", "failed_requests", "p50_ms", "p95_ms", "p99_ms", "max_ms"]
    got, want = ({tuple(r) for r in df.select(*names).collect()} for df in (closed, batch))
    assert got == want and len(got) == 10


def test_late_requests_are_left_out(spark):
    late = [(999, T0, "s0", True, 1.0, 0, 1)]
    _, stream = written(spark, [requests_between(0, 100), requests_between(100, 150), late], LOG)
    windows = append_available(events.request_windows(stream, window="6 hours"), "late")
    assert windows.filter(F.col("window_start") == F.lit(T0)).agg(F.sum("n")).first()[0] == 36


def test_a_backlog_gives_the_same_rows_however_it_is_cut(spark):
    rows = requests_between(0, 150)
    cuts = [[rows], [rows[k::4] for k in range(4)], [rows[100:], rows[:50], rows[50:100]]]
    keys = [*events.WINDOW_KEYS, "system_name"]
    results = []
    for cut in cuts:
        frame, stream = written(spark, cut, LOG)
        windows = update_available(events.request_windows(stream, window="6 hours", delay=None), "backlog", keys)
        once = append_available(events.deduplicate(stream.union(stream), delay=None), "backlog_once")
        results.append((sorted(map(tuple, windows.select(*keys, "n").collect()), key=str), sorted(r.event_id for r in once.collect())))
        assert windows.agg(F.sum("n")).first()[0] == 150 and results[-1][1] == list(range(150))
    assert results[0] == results[1] == results[2]


def test_repeated_events_are_dropped(spark):
    _, stream = written(spark, [requests_between(0, 30), requests_between(27, 40)], LOG)
    once = append_available(events.deduplicate(stream), "once")
    assert sorted(r.event_id for r in once.collect()) == list(range(40))


def test_run_state_over_several_batches(spark):
    schema = "run_id int, version_ord int, changed_at timestamp, status string, error_message string"
    batches = [
        [(1, 0, T0, "pending", None), (2, 0, T0, "running", None)],
        [(1, 1, T0 + timedelta(hours=1), "running", None)],
        [(1, 2, T0 + timedelta(hours=2), "failed", "boom"), (2, 1, T0 + timedelta(hours=3), "completed", None)],
    ]
    frame, stream = written(spark, batches, schema)
    got = update_available(events.run_states(stream), "states", ["run_id"])
    assert {tuple(r) for r in got.select(run_progress(frame).columns).collect()} == {tuple(r) for r in run_progress(frame).collect()}


def test_event_counts_and_approximate_windows(spark):
    frame, stream = written(spark, [requests_between(0, 200)], LOG)
    counts = append_available(
        events.event_counts(stream.withColumn("event_type", F.lit("x")).withColumn("k", F.lit(2)), "k", window="6 hours"), "counts"
    )
    assert {(r.event_count, r.payload_total) for r in counts.collect()} == {(36, 72)}
    approx = append_available(events.approximate_windows(stream, window="6 hours"), "approx")
    assert approx.count() == 10


def test_file_stream_reads_the_named_files_only(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/region.parquet").schema
    rows = append_available(parquet_stream(spark, sf_dir, "region.parquet", schema), "regions")
    assert rows.count() == 5


CHANGES = "run_id int, version_ord long, changed_at timestamp, status string, error_message string"


def changes_of_runs():
    rng = random.Random(11)
    states = [*runs.LIFECYCLE, "unknown", None]
    return [
        (run, k, T0 + timedelta(hours=rng.randrange(200) if run else 0), rng.choice(states), None) for run in range(30) for k in range(rng.randrange(1, 9))
    ]


def plain_lifecycles(rows):
    out = {}
    for run, _, at, status, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        state, since, accepted, rejected = out.get(run, (None, None, 0, 0))
        known = status in runs.LIFECYCLE and state not in runs.TERMINAL_STATES
        if known and (state is None or runs.LIFECYCLE.index(status) > runs.LIFECYCLE.index(state)):
            out[run] = status, at, accepted + 1, rejected
        else:
            out[run] = state, since, accepted, rejected + 1
    return out


def cuts_of(rows):
    shuffled = random.Random(2).sample(rows, len(rows))
    return [[rows], [shuffled[k::5] for k in range(5)], [rows[60:], rows[:60]]]


def test_illegal_changes_are_rejected_however_the_stream_is_cut(spark):
    rows = changes_of_runs()
    want = plain_lifecycles(rows)
    for cut in cuts_of(rows):
        frame, stream = written(spark, cut, CHANGES)
        for found in (runs.run_lifecycles(frame), update_available(runs.run_lifecycles(stream), "lifecycles", ["run_id"])):
            assert {r.run_id: (r.status, r.changed_at, r.accepted, r.rejected) for r in found.collect()} == want


def test_progress_expires_however_the_stream_is_cut(spark):
    newest = T0 + timedelta(hours=415)
    ends = [(900, 0, newest, "running", None), (901, 0, newest - timedelta(hours=24), "running", None), (902, 0, newest - timedelta(hours=24) + timedelta(milliseconds=1), "failed", "x")]
    rows = [*changes_of_runs(), *[(r, k, t + timedelta(hours=210), s, e) for r, k, t, s, e in changes_of_runs() if r % 3 == 0], *ends]
    for cut in cuts_of(rows):
        frame, stream = written(spark, cut, CHANGES)
        want = {tuple(r) for r in runs.latest_progress(frame, ttl_seconds=86400).select("run_id", "version_ord", "changed_at", "status").collect()}
        found = update_available(stateful.latest_progress(stream, 86400), "progress", ["run_id"]).filter("NOT expired")
        got = {tuple(r) for r in found.select("run_id", "version_ord", "changed_at", "status").collect()}
        assert got == want and {r[0] for r in got} >= {900, 902} and 901 not in {r[0] for r in got}


def test_progress_of_runs_that_share_a_bucket(spark):
    """Far more runs than buckets: entries of a list expire one by one, and calls to the state store follow the buckets."""
    rows = [(run, run % 7, T0 + timedelta(minutes=run), "running", None) for run in range(3000)]
    later = [(run, 9, T0 + timedelta(minutes=run + 1000), "failed", "x") for run in range(0, 3000, 5)]
    for cut in ([rows + later], [rows, later], [later[::2], rows[::-1], later[1::2]]):
        frame, stream = written(spark, cut, CHANGES)
        want = {tuple(r) for r in runs.latest_progress(frame, ttl_seconds=86400).select("run_id", "version_ord", "changed_at", "status").collect()}
        found = update_available(stateful.latest_progress(stream, 86400, buckets=3), "progress", ["run_id"])
        got = {tuple(r) for r in found.filter("NOT expired").select("run_id", "version_ord", "changed_at", "status").collect()}
        assert got == want and 0 < len(got) < 3000
        assert found.count() == 3000
