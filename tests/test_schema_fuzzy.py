import difflib
import re

import pytest
from conftest import CATALOG, SALESFORCE, SAP, WAREHOUSE
from pyspark.sql import functions as F

from plumbline.operators import schema_fuzzy as sf


def report(df):
    rows = sf.inconsistency_report(df, ordered=True).collect()
    return [(r.kind, r.severity) for r in rows]


def test_contact_in_two_systems(catalog):
    """Golden G2: one shared entity, no match, five missing fields."""
    c = catalog({"salesforce": SALESFORCE, "sap": SAP})
    assert [r.entity for r in sf.shared_entities(c).collect()] == ["Contact"]
    compared = sf.compare_fields(c)
    similarity = sf.schema_similarity(c, compared).collect()
    assert [(r.matched, r.overall_similarity) for r in similarity] == [(0, 0.0)]
    assert report(compared) == [("missing_field", "HIGH")] * 5


def test_contact_in_three_systems(catalog):
    """Golden G4."""
    c = catalog({"salesforce": SALESFORCE, "sap": SAP, "warehouse": WAREHOUSE})
    compared = sf.compare_fields(c)
    pair = {(r.source_system, r.target_system): r for r in sf.schema_similarity(c, compared).collect()}
    assert pair["salesforce", "warehouse"].matched == 3
    assert pair["salesforce", "warehouse"].overall_similarity == pytest.approx(0.6)
    missing = {(r.side, r.field) for r in sf.missing_fields(c, compared).filter("source_system = 'salesforce' AND target_system = 'warehouse'").collect()}
    assert missing == {("missing_in_target", "Id"), ("missing_in_target", "AccountId"), ("missing_in_source", "contact_id")}
    assert report(compared) == [("missing_field", "HIGH")] * 11


def test_demo_catalogs_share_nothing(catalog):
    c = catalog({"salesforce": {"Account": SALESFORCE["Account"]}, "sap": {"KUNNR": SAP["KUNNR"]}})
    assert sf.shared_entities(c).count() == 0
    assert sf.inconsistency_report(sf.compare_fields(c)).count() == 0


def test_type_mismatch_halves_a_match(catalog):
    """Golden G5."""
    c = catalog({"a": {"e": ["id integer", "created_date timestamp"]}, "b": {"e": ["id integer", "created_date varchar(8)"]}})
    compared = sf.compare_fields(c)
    assert sf.schema_similarity(c, compared).first().overall_similarity == 0.75
    rows = sf.inconsistency_report(compared).collect()
    assert [(r.kind, r.severity, r.detail) for r in rows] == [
        ("type_mismatch", "MEDIUM", "Field 'created_date': timestamp in a vs varchar(8) in b")
    ]


def test_key_mismatch_uses_raw_names(catalog):
    """Golden G6."""
    compared = sf.compare_fields(catalog({"a": {"e": ["Id varchar", "Width int"]}, "b": {"e": ["id varchar", "Width int"]}}))
    assert sf.field_matches(compared).filter("score = 1.0").count() == 2
    (row,) = sf.inconsistency_report(compared).collect()
    assert (row.kind, row.severity, row.detail) == ("key_mismatch", "CRITICAL", "Key fields differ: ['Id', 'Width'] vs ['id', 'Width']")


def test_same_key_names_do_not_differ(catalog):
    compared = sf.compare_fields(catalog({"a": {"e": ["id int", "order_id int"]}, "b": {"e": ["order_id int", "id int"]}}))
    assert sf.key_mismatches(compared).count() == 0


def test_targets_are_reused_and_ties_take_the_earliest(catalog):
    c = catalog({"a": {"e": ["email_addr x", "email_address2 x"]}, "b": {"e": ["email_address x", "EmailAddress x"]}})
    rows = {r.source_field: (r.target_field, r.score) for r in sf.field_matches(sf.compare_fields(c, 0.8)).collect()}
    assert rows["email_addr"][0] == "email_address" and rows["email_address2"][0] == "email_address"


def test_exact_name_ignores_the_threshold(catalog):
    c = catalog({"a": {"e": ["first_name x", "zz x"]}, "b": {"e": ["FirstName x", "zy x"]}})
    assert [r.source_field for r in sf.field_matches(sf.compare_fields(c, 1.1)).collect()] == ["first_name"]


def test_duplicate_definitions_keep_first_position_and_last_type(spark):
    rows = [("a", 0, "e", "x", 0, "int", True, False), ("a", 0, "e", "y", 1, "int", True, False), ("a", 0, "e", "x", 2, "text", True, False)]
    fields = {r.field: (r.field_ord, r.type) for r in sf.unique_fields(spark.createDataFrame(rows, CATALOG)).collect()}
    assert fields == {"x": (0, "text"), "y": (1, "int")}


def test_system_without_fields_still_takes_part(spark):
    rows = [("a", 0, "e", "x", 0, "int", True, False), ("b", 1, "e", None, None, None, None, None)]
    c = spark.createDataFrame(rows, CATALOG)
    compared = sf.compare_fields(c)
    (row,) = sf.schema_similarity(c, compared).collect()
    assert (row.source_fields, row.target_fields, row.matched) == (1, 0, 0)
    assert sf.missing_in_target(compared).count() == 1


def _expected(schemas, threshold):
    """Brute force over all pairs of fields."""
    def norm(n):
        return re.sub("_+", "_", re.sub("[^a-z0-9]", "_", re.sub("([A-Z])", r"_\1", n).lower())).strip("_")

    out = {}
    systems = list(schemas)
    for i, a in enumerate(systems):
        for b in systems[i + 1:]:
            for entity in set(schemas[a]) & set(schemas[b]):
                for source in schemas[a][entity]:
                    s, best, best_score = norm(source.split(" ")[0]), None, 0.0
                    for target in schemas[b][entity]:
                        t = norm(target.split(" ")[0])
                        if s == t:
                            best, best_score = target, 1.0
                            break
                        if not s or not t or max(len(s), len(t)) > 3 * min(len(s), len(t)):
                            continue
                        score = difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
                        if score > best_score and score >= threshold:
                            best, best_score = target, score
                    if best:
                        out[entity, a, b, source.split(" ")[0]] = (best.split(" ")[0], best_score)
    return out


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.8])
def test_matches_equal_brute_force(catalog, threshold):
    schemas = {
        "crm": {"Contact": SALESFORCE["Contact"], "Account": SALESFORCE["Account"]},
        "erp": {"Contact": ["ContactId x", "FirstNam x", "Last_Name x", "EmailAddress x", "Phone1 x"], "Account": ["AccountName x", "Revenue x", "created x"]},
        "dwh": {"Contact": WAREHOUSE["Contact"] + ["first_nm x", "phone x"], "Account": ["acct_name x", "annual_rev x", "created_dt x", "billing_st x"]},
    }
    got = {
        (r.entity, r.source_system, r.target_system, r.source_field): (r.target_field, r.score)
        for r in sf.field_matches(sf.compare_fields(catalog(schemas), threshold)).collect()
    }
    assert got == _expected(schemas, threshold)


def test_published_benchmark_shape(spark):
    """Five systems with the same twenty entities: everything matches, nothing is reported."""
    from bench import catalog_shape

    c = catalog_shape(spark, 5, 20, 30)
    compared = sf.compare_fields(c)
    assert sf.field_matches(compared).count() == 10 * 20 * 30
    assert sf.inconsistency_report(compared).count() == 0
    assert sf.schema_similarity(c, compared).filter(F.col("overall_similarity") == 1).count() == 200


def test_word_load_has_all_words_of_documents(spark, sf_dir):
    from plumbline.plans.inputs import document_vocabulary

    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(f"system_{k % 4}", f"domain_{k // 4 % 2}", w) for k, t in texts for w in re.split("[^a-z0-9_]+", t.lower()) if w}
    assert {(r.system, r.entity, r.field) for r in document_vocabulary(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_hot_keys_are_cut_without_loss(spark, monkeypatch, threshold):
    from plumbline.operators import similar_names

    monkeypatch.setattr(similar_names, "CELL", 2)
    stems = ["customer", "billing_address", "order_line_number", "antidisestablishment", "th", "a"]
    names = sorted({s[:k] + x + s[k:] for s in stems for k in range(0, len(s), 3) for x in ("", "e", "xy", "_ab")})
    df = spark.createDataFrame([("e", n) for n in names], "entity string, n string")
    pairs = similar_names.candidate_pairs(df.withColumnRenamed("n", "source_norm"), df.withColumnRenamed("n", "target_norm"), threshold, ["entity"])
    got = {(r.source_norm, r.target_norm) for r in similar_names.score_pairs(pairs, threshold).collect()}
    want = {
        (a, b) for a in names for b in names
        if a != b and max(len(a), len(b)) <= 3 * min(len(a), len(b)) and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold
    }
    assert got == want


def test_short_names_with_one_beginning_do_not_all_meet(spark):
    """Sixteen names that begin alike and are within no edit of each other."""
    from plumbline.operators import similar_names

    names = ["th" + a + b + c + d for a, b, c, d in ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yz01", "2345"]]
    names += [n[:2] + n[:1:-1] for n in names]
    df = spark.createDataFrame([("e", n) for n in names], "entity string, n string")
    met = similar_names.met_pairs(df.withColumnRenamed("n", "source_norm"), df.withColumnRenamed("n", "target_norm"), 0.8, ["entity"])
    assert met.filter("source_norm <> target_norm").count() == 0


def test_fields_are_dealt_by_entity_once(spark):
    """No row moves again by entity and target system, which made ten rows of a field in the shuffle."""
    import re

    from plumbline.operators import schema_fuzzy
    from plumbline.sources.folders import stored

    rows = [(f"s{s}", s, f"e{e}", f"some_field{f}", f, "int", True, f == 0) for s in range(4) for e in range(3000) for f in range(4) if (s + e + f) % 3]
    kinds = "system string, system_ord long, entity string, field string, field_ord int, type string, nullable boolean, pk boolean"
    fields = stored(spark.createDataFrame(rows, kinds), "fields")
    names = schema_fuzzy.compare_fields(fields, 0.8, stored)
    joined = [line for line in names._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert joined and not [line for line in joined if re.search(r"hashpartitioning\([^)]*target_system", line)]
    assert names.count() == sum(1 for a in rows for s in range(a[1] + 1, 4))
