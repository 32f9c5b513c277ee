import random
import re

import pytest
from conftest import CATALOG

from pyspark.sql import functions as F

from plumbline.functions.types import TYPE_GROUPS, type_group
from plumbline.operators import schema_exact as se
from plumbline.plans import assessment

PAIR = {
    "salesforce": {"Account": ["Id varchar*", "Name varchar", "Email varchar", "Phone varchar"]},
    "sap": {"Account": ["Id varchar*", "Name nvarchar", "Revenue decimal"]},
}


def test_mapping_and_consistency(catalog):
    """Golden G7."""
    c = catalog(PAIR)
    got = {r.source_field: (r.target_field, r.similarity_score, r.mapping_type) for r in se.field_mapping(c).collect()}
    assert got == {
        "Id": ("Id", 1.0, "exact"), "Name": ("Name", 0.9, "exact"), "Email": ("", 0.0, "unmapped"), "Phone": ("", 0.0, "unmapped"),
    }
    assert se.consistency_score(c).first().consistency_score == pytest.approx(0.475)


def test_findings_both_directions(catalog):
    rows = {(r.field_name, r.source_system, r.target_system, r.severity) for r in se.findings(catalog(PAIR)).collect()}
    assert rows == {
        ("Email", "salesforce", "sap", "MEDIUM"), ("Phone", "salesforce", "sap", "MEDIUM"), ("Revenue", "sap", "salesforce", "MEDIUM"),
    }


def test_missing_key_is_high_and_types_differ(catalog):
    c = catalog({"a": {"e": ["id int*", "d date"]}, "b": {"e": ["d varchar", "x "]}, "c": {"e": ["d ", "x int"]}})
    found = {(r.inconsistency_type, r.field_name, r.source_system, r.target_system): r for r in se.findings(c).collect()}
    assert found["missing_field", "id", "a", "b"].severity == "HIGH"
    mismatch = [k for k in found if k[0] == "type_mismatch"]
    assert mismatch == [("type_mismatch", "d", "a", "b")]
    row = found[mismatch[0]]
    assert (row.source_definition, row.target_definition, row.severity) == ("date", "varchar", "HIGH")


def test_canonical_schema(catalog):
    rows = {r.field: (r.data_type, r.nullable, r.is_primary_key) for r in se.canonical_schema(catalog(PAIR)).collect()}
    assert rows["Id"] == ("varchar", False, True)
    assert rows["Name"] == ("varchar", False, False)
    assert rows["Revenue"] == ("decimal", True, False)


def test_single_system_is_consistent(catalog):
    c = catalog({"a": {"e": ["id int", " int"]}})
    assert se.consistency_score(c).first().consistency_score == 1.0
    assert [r.field for r in se.canonical_schema(c).collect()] == ["id"]


def test_full_analysis_scope(spark, catalog):
    c = catalog({**PAIR, "old": {"Account": ["Id varchar"]}})
    systems = spark.createDataFrame([("salesforce", "connected"), ("sap", "connected"), ("old", "failed")], "name string, status string")
    wanted = spark.createDataFrame([("Account",), ("Missing",)], "entity string")
    result = se.analyze_schemas(c, systems, wanted)
    assert result["inconsistencies"].count() == 3
    assert [r.entity for r in result["consistency"].collect()] == ["Account"]


def plain_mappings(rows):
    """Every field of a system against each later system of the entity: (entity, score)."""
    group = {t: names[0] for names in TYPE_GROUPS for t in names}
    out = []
    for system, order, entity, field, kind in rows:
        for other, later in {(s, o) for s, o, e, _, _ in rows if e == entity and o > order}:
            if not field:
                continue
            found = [k for s, _, e, f, k in rows if (s, e, f) == (other, entity, field)]
            a, b = (kind or "").strip().lower(), (found[0] or "").strip().lower() if found else ""
            same = group.get(a, a) == group.get(b, b)
            out.append((entity, 0.0 if not found else 0.5 if not kind or not found[0] else 1.0 if a == b else 0.9 if same else 0.2))
    return out


@pytest.fixture(scope="module")
def many_systems(spark):
    """70 systems, so that a presence bitmap has two words; some without fields, some with an empty name."""
    rng = random.Random(7)
    kinds = ["varchar", "TEXT ", "int", "bigint", "date", "", None, "blob", "varchar(10)"]
    rows = []
    for n in range(70):
        for entity in ("e", "f") if n % 5 else ("e",):
            fields = [f for f in ("id", "a", "b", "c") if rng.random() < 0.8] if n != 3 else []
            rows += [(f"s{n:02d}", 100 - n, entity, f, rng.choice(kinds)) for f in ["all", *fields]] if n != 3 else [("s03", 97, entity, None, None)]
    rows.append(("s01", 99, "e", "", "int"))
    table = [(s, o, e, f, k, t, True, f == "id") for k, (s, o, e, f, t) in enumerate(rows)]
    return rows, spark.createDataFrame(table, CATALOG)


def test_counted_scores_equal_scores_of_all_pairs(many_systems):
    rows, table = many_systems
    want = {}
    for entity, score in plain_mappings(rows):
        want.setdefault(entity, []).append(score)
    got = {r.entity: (r.mappings, r.consistency_score) for r in se.consistency_score(table).collect()}
    assert got == {e: (len(s), pytest.approx(sum(s) / len(s))) for e, s in want.items()}


def test_absent_systems_are_the_complement(many_systems):
    rows, table = many_systems
    every = {(s, e) for s, _, e, _, _ in rows}
    want = {(e, f, s, o) for s, _, e, f, _ in rows if f for o, x in every if x == e and not any((a, b, c) == (o, e, f) for a, _, b, c, _ in rows)}
    found = se.missing_field_findings(table).collect()
    assert {(r.entity, r.field_name, r.source_system, r.target_system) for r in found} == want and len(found) == len(want)
    assert "all" in {r.field for r in se.absent_systems(table).collect()}  # s03 has no field at all


def test_fields_that_no_system_lacks_have_no_row(catalog):
    assert se.absent_systems(catalog(PAIR)).filter("field IN ('Id', 'Name')").count() == 0


def test_differing_types_are_the_pairs_of_other_groups(many_systems):
    rows, table = many_systems
    group = {t: names[0] for names in TYPE_GROUPS for t in names}
    kind = lambda t: group.get(t.strip().lower(), t.strip().lower())
    want = {
        (e, f, s, x) for s, o, e, f, t in rows if f and t for x, p, y, g, u in rows if (y, g) == (e, f) and u and o < p and kind(t) != kind(u)
    }
    found = [(r.entity, r.field_name, r.source_system, r.target_system) for r in se.type_mismatch_findings(table).collect()]
    assert set(found) == want and len(found) == len(want)


def moved_by_key(frame):
    """Exchanges of the plan that deal rows by a key; those written again in full, not read as reused ones."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_differing_types_move_rows_once(many_systems, fixed_plans):
    assert moved_by_key(se.type_mismatch_findings(many_systems[1])) == 1


def test_missing_fields_move_fields_once_and_systems_once(many_systems, fixed_plans):
    assert moved_by_key(se.missing_field_findings(many_systems[1])) == 2


def test_group_of_a_type_works_the_key_out_once(spark):
    kinds = [" VARCHAR\t", "Numeric ", "blob", "", None, " ", "bit", "varchar(3)"]
    frame = spark.createDataFrame([(k,) for k in kinds], "type string").select(type_group(F.col("type")).alias("g"))
    assert [r.g for r in frame.collect()] == ["varchar", "float", "blob", None, None, "", "bool", "varchar(3)"]
    assert frame._jdf.queryExecution().analyzed().toString().count("lower(") <= 2


def test_assessment_stores_findings_without_texts_and_sorts_none_for_its_totals(spark, many_systems, monkeypatch):
    stored = {}

    def store(frame, label):
        stored[label] = frame.columns
        return frame.localCheckpoint()

    monkeypatch.setattr(assessment.exact_findings, "__defaults__", (store,))
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    result = assessment.assess_exact(runs, many_systems[1].withColumn("run_id", F.lit(1).cast("long")))
    assert stored["exact_findings"] == se.BARE and "impact_description" in result["findings"].columns
    assert "Window" not in result["effort"]._jdf.queryExecution().optimizedPlan().toString()
    numbers = result["plan"].filter("run_id = 1").select("recommended_sequence").collect()
    counted = {r.run_id: r.item_count for r in result["effort"].collect()}
    assert sorted(r[0] for r in numbers) == list(range(1, counted[1] + 1)) and counted[2] == 0


def test_analysis_deals_its_scope_by_entity_alone(spark, many_systems, fixed_plans):
    systems = spark.createDataFrame([(f"s{n:02d}", "connected") for n in range(70)], "name string, status string")
    wanted = spark.createDataFrame([("e",), ("f",)], "entity string")
    found = se.analyze_schemas(many_systems[1], systems, wanted)["inconsistencies"]
    # No shuffle has more than one key (and its number of partitions): none deals rows by entity and field, or by system.
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert keys and all(len(k.split(", ")) == 2 for k in keys)


def test_scores_mappings_and_schemas_deal_rows_once_per_side(many_systems, fixed_plans):
    """Fields, systems and targets, into a number of tasks that is set: tasks merged by their bytes on disk held too many rows to sort."""
    for build in (se.consistency_score, se.canonical_schema, se.field_mapping):
        plan = build(many_systems[1])
        assert moved_by_key(plan) <= 3
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("REPARTITION_BY_NUM") >= 2 and "ENSURE_REQUIREMENTS" not in text
