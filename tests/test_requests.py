import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import requests as req
from plumbline.operators.ranking import number_rows

LOG = "run_id int, system_name string, start_us long, end_us long, latency_ms double, success boolean"


def log(spark, latencies, run=1, failed=0):
    rows = [(run, "s", i * 1000, i * 1000 + 500, float(v), True) for i, v in enumerate(latencies)]
    rows += [(run, "s", 0, 1, 1.0, False)] * failed
    return spark.createDataFrame(rows, LOG)


def test_percentiles_of_one_to_hundred(spark):
    """Golden G9."""
    m = req.request_metrics(log(spark, range(1, 101))).first()
    assert (m.p50_ms, m.p95_ms, m.p99_ms, m.max_ms) == (50.5, 96.0, 100.0, 100.0)


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 257])
def test_percentiles_equal_a_sorted_list(spark, n):
    rng = random.Random(n)
    values = [rng.choice([5000.0, 0.0, rng.uniform(0, 3), rng.uniform(0, 4000)]) for _ in range(n)]
    m = req.request_metrics(log(spark, values)).first()
    ordered = sorted(values)
    assert m.p50_ms == statistics.median(values)
    assert m.p95_ms == ordered[min(int(n * 0.95), n - 1)]
    assert m.p99_ms == ordered[min(int(n * 0.99), n - 1)]


def test_no_success_gives_zero(spark):
    m = req.request_metrics(log(spark, [], failed=3)).first()
    assert (m.total_requests, m.failed_requests, m.error_rate_pct, m.p50_ms, m.p95_ms, m.max_ms) == (3, 3, 100.0, 0, 0, 0)


def test_weighted_rows_stand_for_requests(spark):
    plain = req.request_metrics(log(spark, [1, 1, 1, 2, 3, 3]))
    packed = spark.createDataFrame(
        [(1, "s", 0, 5500, 1.0, True, 3), (1, "s", 3000, 3500, 2.0, True, 1), (1, "s", 4000, 5500, 3.0, True, 2)], LOG + ", n long"
    )
    assert plain.first().asDict() == req.request_metrics(packed, weight="n").first().asDict()


def test_short_runs_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(1, "s", 5, 5, 1.0, True)], LOG)
    assert req.request_metrics(df).first().actual_qps == 1000.0


@pytest.mark.parametrize(
    "error_rate,p95,found,healthy",
    [
        (4.9, 999.0, [], True), (5.0, 10.0, [("error_rate", "HIGH")], False), (10.0, 3000.0, [("error_rate", "CRITICAL"), ("latency_p95", "CRITICAL")], False),
        (0.0, 1000.0, [("latency_p95", "HIGH")], False),
    ],
)
def test_health_and_bottlenecks(spark, error_rate, p95, found, healthy):
    m = spark.createDataFrame([(1, "s", error_rate, p95)], "run_id int, system_name string, error_rate_pct double, p95_ms double")
    rows = req.bottlenecks(m).orderBy("bottleneck_ord").collect()
    assert [(r.bottleneck_type, r.severity) for r in rows] == found
    h = req.health(m).first()
    assert (h.is_healthy, h.overall_health) == (healthy, "HEALTHY" if healthy else "DEGRADED")


def test_outcomes(spark):
    at = datetime(2024, 1, 1)
    raw = spark.createDataFrame(
        [(1, at, 10.5, True, None), (2, at, 9000.0, True, None), (3, at, 5.0, None, "x" * 300), (4, at, 5.0, False, None)],
        "request_id int, start_ts timestamp, elapsed_ms double, result boolean, exception string",
    )
    got = {r.request_id: r for r in req.normalise_outcomes(raw, 5000).collect()}
    assert (got[1].success, got[1].latency_ms, got[1].end_us - got[1].start_us) == (True, 10.5, 10500)
    assert (got[2].success, got[2].latency_ms, got[2].error) == (False, 5000.0, "timeout")
    assert (got[3].success, got[3].error) == (False, "x" * 100)
    assert (got[4].success, got[4].error) == (False, None)


def test_connection_summary(spark):
    rows = [(1, "a", "connected", None), (1, "b", "failed", "refused"), (1, "c", "pending", ""), (2, "d", "connected", "slow")]
    df = spark.createDataFrame(rows, "run_id int, name string, status string, error string")
    got = {r.run_id: (r.total, r.healthy, r.failed, r.pending, r.success_rate) for r in req.connection_summary(df).collect()}
    assert got == {1: (3, 1, 1, 1, pytest.approx(1 / 3)), 2: (1, 1, 1, 0, 1.0)}


def test_breaking_point(spark):
    rows = [("s", 0, 100.0, 0.0, 5.0), ("s", 1, 200.0, 1.0, 10.0), ("s", 2, 250.0, 6.0, 15.0), ("s", 3, 400.0, 0.0, 20.0)]
    df = spark.createDataFrame(rows, "system_name string, phase int, p95_ms double, error_rate_pct double, actual_qps double")
    r = req.breaking_points(df, ["system_name"]).first()
    assert (r.baseline_p95_ms, r.breaking_phase, r.max_safe_qps) == (100.0, 2, 15.0)


@pytest.mark.parametrize("rows_per_bucket", [3, 1 << 20])
def test_row_numbers_of_a_dominant_group(spark, rows_per_bucket):
    data = [(0 if i % 3 else i % 7, i * 5 % 1009, i % 4) for i in range(1000)]
    df = spark.createDataFrame(data, "g int, pos int, cls int")
    got = number_rows(df, ["g"], "pos", [-F.col("cls")], "n", rows_per_bucket).collect()
    want = {}
    for g, pos, cls in sorted(data, key=lambda r: (r[0], -r[2], r[1])):
        want.setdefault(g, []).append((cls, pos))
    assert len(got) == 1000
    assert all(want[r.g][r.n - 1] == (r.cls, r.pos) for r in got)
