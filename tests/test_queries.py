"""Every registered query against its check SQL, and the shape of the plans."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, database
from oracles import ORACLES
from plumbline.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    mine = QUERIES[name](spark, sf_dir)
    assert compare(mine.toPandas(), con.execute(ORACLES[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {n for n in QUERIES if n.startswith("stream_")}))
def test_plan_has_no_product_and_no_row_function(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert operator not in plan


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == QUERIES[entry.FLAGSHIP](spark, sf_dir).columns


def test_sources_use_no_driver_side_rows():
    root = os.path.join(os.path.dirname(entry.__file__), "plumbline")
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    text = f.read()
                for call in (".collect()", ".toPandas()", ".localCheckpoint(", "crossJoin", ".rdd"):
                    assert call not in text, f"{name}: {call}"


def test_word_matches_equal_brute_force(spark, sf_dir):
    """The queries without SQL, on the smallest tables: every pair of words by hand."""
    import difflib

    from plumbline.plans.inputs import vocabulary_catalog

    words = sorted((r.entity, r.system_ord, r.field_ord, r.system, r.field) for r in vocabulary_catalog(spark, sf_dir).collect())
    want, scores = {}, {}
    for entity, source_ord, _, source, a in words:
        targets = [w for w in words if w[0] == entity and w[1] > source_ord]
        for system in {w[3] for w in targets}:
            best, best_score = None, 0.0
            for *_, b in (w for w in targets if w[3] == system):
                score = 1.0 if a == b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
                if score > best_score and score >= 0.8 and max(len(a), len(b)) <= 3 * min(len(a), len(b)):
                    best, best_score = b, score
            if best:
                want[entity, source, system, a] = (best, best_score)
        for b in {w[4] for w in words if w[0] == entity and w[4] != a}:
            score = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            if score >= 0.8:
                scores[a, b] = score
    rows = QUERIES["fuzzy_match"](spark, sf_dir).collect()
    assert {(r.entity, r.source_system, r.target_system, r.source_field): (r.target_field, r.score) for r in rows} == want
    pairs = QUERIES["name_similarity"](spark, sf_dir).collect()
    assert {(r.source_norm, r.target_norm): r.score for r in pairs} == scores
    missing = sum(r.n for r in QUERIES["fuzzy_report"](spark, sf_dir).collect() if r.kind == "missing_field")
    facing = sum(len({w[3] for w in words if w[0] == e and w[1] > o}) for e, o, *_ in words)
    assert missing == facing - len(want)
