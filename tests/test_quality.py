import pytest

from plumbline.operators import quality as q


def rows(df):
    return {(r.check_name, r.column): r for r in df.collect()}


def test_profile_golden(spark):
    """Golden G8."""
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, None, None)], "id int, name string, email string")
    results = q.profile_table(df, "s", "t")
    got = rows(results)
    assert got["completeness", "id"].severity == "CRITICAL"
    assert got["completeness", "id"].details == "33.3% null rate in id"
    assert got["completeness", "name"].severity == "HIGH" and got["completeness", "name"].details == "100.0% null rate in name"
    assert got["uniqueness", "id"].score == 0.5 and got["uniqueness", "id"].details == "1 duplicate values in id"
    assert q.overall_quality(results, ["system"]).first().quality_score == pytest.approx(0.15)


@pytest.mark.parametrize("nulls,reported", [(5, 0), (6, 1)])
def test_gate_is_above_five_percent(spark, nulls, reported):
    df = spark.createDataFrame([(None if n < nulls else "x",) for n in range(100)], "value string")
    assert q.completeness(df, "s", "t").count() == reported


def test_key_column_below_the_gate_is_silent(spark):
    df = spark.createDataFrame([(None if n < 3 else n,) for n in range(100)], "user_key int")
    assert q.completeness(df, "s", "t").count() == 0
    assert q.null_rates(df, "s", "t").first().null_rate == 0.03


def test_empty_table_has_no_results(spark):
    df = spark.createDataFrame([], "id int, name string")
    assert q.profile_table(df, "s", "t").count() == 0


def test_empty_strings_count_and_nan_does_not(spark):
    df = spark.createDataFrame([("", float("nan")), ("a", 1.0)], "note string, amount double")
    assert {r.column: r.null_count for r in q.null_rates(df, "s", "t").collect()} == {"note": 1, "amount": 0}


def test_falsy_values_are_not_duplicates(spark):
    df = spark.createDataFrame([(0, "", False), (0, "", False), (1, "a", True), (2, "b", True)], "id int, uid string, valid boolean")
    got = rows(q.uniqueness(df, "s", "t"))
    assert set(got) == {("uniqueness", "valid")}


def test_all_identifiers_or_the_first_three(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1)] * 2, "foreign_id int, a_id int, paid int, width int, d_id int")
    assert {c for _, c in rows(q.uniqueness(df, "s", "t", limit=3))} == {"a_id", "paid", "width"}
    assert {c for _, c in rows(q.uniqueness(df, "s", "t"))} == {"a_id", "paid", "width", "d_id"}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "`a.b id` int, `c``d id` int")
    assert {c for _, c in rows(q.profile_table(df, "s", "t"))} == {"a.b id", "c`d id"}


def test_overall_quality(spark):
    data = [(1, "CRITICAL", False), (1, "INFO", True), (2, "LOW", True), (3, "ODD", False), (3, "HIGH", False)]
    results = spark.createDataFrame(data, "run_id int, severity string, passed boolean")
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run_id int")
    got = {r.run_id: r.quality_score for r in q.overall_quality(results, ["run_id"], runs).collect()}
    assert got == pytest.approx({1: 0.5, 2: 1.0, 3: 0.4, 4: 1.0})


def test_referential_integrity(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    r = q.referential_integrity(child, "k", parent, "id", "s", "t").first()
    assert (r.checked_rows, r.orphan_rows, r.orphan_keys, r.orphan_rate, r.passed) == (4, 2, 1, 0.5, False)


def test_format_consistency(spark):
    df = spark.createDataFrame([("AB-12",), ("C-3",), ("12",), (None,), ("",)], "code string")
    r = q.format_consistency(df, ["code"], "s", "t").first()
    assert (r.modal_shape, r.checked_rows, r.shape_count, r.passed) == ("A-9", 3, 2, False)
    assert r.score == pytest.approx(2 / 3)
