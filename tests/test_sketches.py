import random

from plumbline.operators import sketches as sk


def test_distinct_counts_are_within_the_bound_on_every_level(spark):
    rng = random.Random(1)
    rows = [(k % 7, rng.randrange(40_000), f"v{rng.randrange(30)}", None) for k in range(60_000)]
    table = spark.createDataFrame(rows, "g int, id long, few string, none string")
    made = sk.distinct_sketches(table, ["g"], ["id", "few", "none"])
    got = {(r.g, r.column): r for r in sk.uniqueness_estimates(sk.all_levels(made, sk.merged_distinct, [["g"], []])).collect()}
    for g in [*range(7), None]:
        mine = [r for r in rows if g is None or r[0] == g]
        for at, name in ((1, "id"), (2, "few")):
            exact, found = len({r[at] for r in mine}), got[g, name]
            assert abs(found.distinct - exact) <= 4 * sk.DISTINCT_ERROR * exact and found["values"] == len(mine)
            assert found.score_low <= exact / len(mine) * 1.02 and found.score_high >= exact / len(mine) * 0.98
        assert (got[g, "none"]["values"], got[g, "none"].distinct) == (0, 0)


def test_percentiles_are_within_the_rank_error_after_merging(spark):
    rng = random.Random(2)
    rows = [(k % 50, rng.random() > 0.1, rng.lognormvariate(4, 1)) for k in range(40_000)] + [(99, False, 5.0)]
    table = spark.createDataFrame(rows, "run_id int, success boolean, latency_ms double")
    made = sk.latency_sketches(table, ["run_id"])
    whole = sk.latency_estimates(sk.merged_latencies(made, [])).first()
    latencies = sorted(x for _, ok, x in rows if ok)
    for name, share in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        rank = sum(x <= whole[name] for x in latencies) / len(latencies)
        assert abs(rank - share) <= 2 * sk.RANK_ERROR
    assert whole.total_requests == len(rows) and whole.max_ms == latencies[-1]
    none = sk.latency_estimates(made.filter("run_id = 99")).first()
    assert none.p50_ms is None and none.error_rate_pct == 100


def test_empty_tables(spark):
    table = spark.createDataFrame([], "g int, id long, success boolean, latency_ms double")
    assert sk.uniqueness_estimates(sk.merged_distinct(sk.distinct_sketches(table, ["g"], ["id"]), ["g"])).count() == 0
    assert sk.latency_estimates(sk.merged_latencies(sk.latency_sketches(table, ["g"]), ["g"])).count() == 0
