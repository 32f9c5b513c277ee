import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dependencies as dep
from plumbline.operators import remediation


def tiers(spark, edges, topics=()):
    needs = spark.createDataFrame([(1, a, b) for a, b in edges], "run_id long, topic string, needs string")
    listed = spark.createDataFrame([(1, t) for t in topics], "run_id long, topic string")
    return {r.topic: (r.tier, r.cycle) for r in dep.topic_tiers(listed, needs).collect()}


def test_tier_is_the_longest_chain(spark):
    edges = [("d", "c"), ("c", "b"), ("b", "a"), ("d", "a"), ("e", "a"), ("a", "a")]
    want = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 1, "alone": 0}
    assert tiers(spark, edges, ["a", "alone", "alone"]) == {t: (k, False) for t, k in want.items()}


def test_cycles_have_no_tier_and_are_reported(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("behind", "a"), ("c", "root"), ("x", "y"), ("y", "x"), ("x", "link"), ("link", "b")]
    got = tiers(spark, edges)
    assert got["root"] == (0, False) and got["behind"] == (None, False)
    assert all(got[t] == (None, True) for t in ("a", "b", "c", "x", "y", "link"))


def test_random_graphs(spark):
    rng = random.Random(3)
    edges = {(run, rng.randrange(12), rng.randrange(12)) for run in range(25) for _ in range(rng.randrange(16))}
    needs = spark.createDataFrame([(r, f"t{a}", f"t{b}") for r, a, b in edges], "run_id long, topic string, needs string")
    got = {(r.run_id, r.topic): r.tier for r in dep.topic_tiers(needs.select("run_id", "topic"), needs).collect()}
    below = {}
    for r, a, b in edges:
        below.setdefault((r, f"t{a}"), set()).update({(r, f"t{b}")} - {(r, f"t{a}")})
        below.setdefault((r, f"t{b}"), set())

    def depth(node, path=()):
        if node in path:
            return None
        found = [depth(x, (*path, node)) for x in below[node]]
        return None if None in found else max([0, *[d + 1 for d in found]])

    assert got == {node: depth(node) for node in below if below[node] or any(node in x for x in below.values()) or node in got}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run_id long, topic string, needs string")
    assert dep.topic_tiers(none.select("run_id", "topic"), none).count() == 0


@pytest.fixture(scope="module")
def plan(spark):
    findings = [
        (1, 0, "Order", None, "missing_field", "CRITICAL"), (1, 1, "Customer", "id", "type_mismatch", "LOW"),
        (1, 2, "Customer", "name", "missing_field", "HIGH"), (1, 3, "Line", "x", "missing_field", "CRITICAL"), (2, 0, "Order", "x", "missing_field", "LOW"),
    ]
    schema = "run_id long, input_ord long, entity_name string, field_name string, kind string, severity string"
    findings = spark.createDataFrame(findings, schema).withColumns({"remediation_hint": F.lit("h"), "impact_description": F.lit("i"), "finding_id": F.concat(F.lit("f"), "input_ord")})
    gaps = spark.createDataFrame(
        [(1, 0, "g0", "semantic_layer", "CRITICAL"), (1, 1, "g1", "etl_pipeline", "LOW"), (1, 2, "g2", "rest_api", "LOW")],
        "run_id long, input_ord long, gap_id string, gap_type string, severity string",
    ).withColumns({"blocking": F.lit(False), "description": F.lit("d"), "source_system": F.lit("a"), "target_system": F.lit("b"), "recommended_solution": F.lit("s"), "effort_min": F.lit(1), "effort_max": F.lit(2)})
    keys = spark.createDataFrame([(1, "Order", "Customer"), (1, "Line", "Order"), (1, "Line", "Line")], "run_id long, entity string, parent string")
    items = remediation.plan_items(findings=findings, gaps=gaps)
    needs = dep.entity_needs(keys).unionByName(dep.gap_needs(gaps))
    return dep.tiered_plan(items, dep.topic_tiers(items.select("run_id", "topic"), needs), needs).cache()


def test_plan_does_what_is_needed_first(plan):
    rows = {(r.run_id, r.title): r for r in plan.collect()}
    first = rows[1, "Resolve type mismatch for 'Customer'.id"]
    order, line = rows[1, "Resolve missing field for 'Order'"], rows[1, "Resolve missing field for 'Line'.x"]
    # The less severe of both customer items completes the topic.
    assert order.prerequisites == [first.item_id] and line.prerequisites == [order.item_id]
    assert (first.tier, order.tier, line.tier) == (0, 1, 2)
    layer = rows[1, "Implement semantic layer between a and b"]
    assert layer.prerequisites == [rows[1, "Implement etl pipeline between a and b"].item_id] and layer.tier == 1
    assert rows[1, "Implement rest api between a and b"].tier == 0 and rows[2, "Resolve missing field for 'Order'.x"].prerequisites == []
    assert dep.open_prerequisites(plan).count() == 0


def test_items_name_their_findings(plan):
    rows = {(r.run_id, r.title): r.related_gap_ids for r in plan.collect()}
    assert rows[1, "Resolve missing field for 'Line'.x"] == ["f3"] and rows[1, "Implement rest api between a and b"] == ["g2"]


def test_chain_takes_the_longest_item_of_every_tier(plan):
    rows = {r.run_id: (r.tiers, r.min_days, r.max_days) for r in dep.critical_chain(plan).collect()}
    assert rows == {1: (3, 5 + 21 + 21, 21 + 90 + 90), 2: (1, 0, 1)}


def test_ids_worked_out_at_the_end_are_those_carried(spark, plan):
    items = plan.drop("item_id", "tier", "cycle", "recommended_sequence", "prerequisites")
    tiers = plan.select("run_id", "topic", "tier", "cycle").distinct()
    edges = [("entity:Order", "entity:Customer"), ("entity:Line", "entity:Order"), ("gap:semantic_layer", "gap:etl_pipeline")]
    needs = spark.createDataFrame([(1, a, b) for a, b in edges], "run_id long, topic string, needs string")
    late = dep.tiered_plan(items, tiers, needs, remediation.item_id)
    columns = ["run_id", "recommended_sequence", "title", "item_id", "tier", "prerequisites"]
    assert sorted(late.select(columns).collect()) == sorted(plan.select(columns).collect())
    moved = [line for line in late._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any("sha2" in line for line in moved)
