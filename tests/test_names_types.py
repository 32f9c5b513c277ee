import difflib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names, text, types
from plumbline.operators.similar_names import candidate_pairs, score_pairs


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalised_names(spark):
    given = ["FirstName", "KUNNR", "USRID_LONG", "first_name", "e-mail  Address", "__x__", "", "Ünïcode9", "a.b.c"]
    assert column(spark, given, names.normalize_field_name) == [
        "first_name", "k_u_n_n_r", "u_s_r_i_d_l_o_n_g", "first_name", "e_mail_address", "x", "", "n_code9", "a_b_c",
    ]


def test_name_similarity_goldens(spark):
    pairs = [
        ("email_address", "email_addr", 0.8696), ("customer_id", "product_sku", 0.1818), ("first_name", "last_name", 0.7368),
        ("CustomerId", "customer_id", 1.0), ("a", "abcd", 0.0), ("", "x", 0.0), ("__", "", 1.0),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for row in df.select("want", names.field_similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert row.got == pytest.approx(row.want, abs=5e-5)


def _names(count, seed):
    rng = random.Random(seed)
    words = ["cust", "customer", "id", "name", "first", "last", "billing", "addr", "address", "date", "created", "x", "no", "code"]
    out = set()
    while len(out) < count:
        name = "_".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.5:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("abcxyz_019") + name[at + rng.randint(0, 1):]
        out.add(re.sub("_+", "_", name).strip("_") or "q")
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.7, 0.8, 0.95])
def test_candidates_lose_nothing(spark, threshold):
    vocabulary = _names(160, 7)
    def within(a, b):
        return max(len(a), len(b)) <= 3 * min(len(a), len(b))

    want = {}
    for a, b in itertools.permutations(vocabulary, 2):
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        if within(a, b) and ratio >= threshold:
            want[a, b] = ratio
    rows = [("e", n) for n in vocabulary]
    sources = spark.createDataFrame(rows, "entity string, source_norm string")
    targets = spark.createDataFrame(rows, "entity string, target_norm string")
    pairs = candidate_pairs(sources, targets, threshold, ["entity"])
    got = {(r.source_norm, r.target_norm): r.score for r in score_pairs(pairs, threshold).collect()}
    assert got == want


def test_candidates_stay_inside_their_entity(spark):
    sources = spark.createDataFrame([("a", "customer_id"), ("b", "order_id")], "entity string, source_norm string")
    targets = spark.createDataFrame([("a", "customer_ids"), ("b", "customer_ids")], "entity string, target_norm string")
    rows = candidate_pairs(sources, targets, 0.8, ["entity"]).collect()
    assert [tuple(r) for r in rows] == [("a", "customer_id", "customer_ids")]


def test_type_base(spark):
    given = ["varchar(255)", " VARCHAR ", "character varying", "NUMBER(18,2)", "123", "", "timestamp with time zone"]
    assert column(spark, given, types.type_base) == ["varchar", "varchar", "character", "number", "123", "", "timestamp"]


def test_types_compatible(spark):
    pairs = [
        ("varchar(10)", "text", True), ("text", "varchar", True), ("int", "bigint", True), ("smallint", "integer", False),
        ("text", "char", False), ("decimal(10,2)", "numeric", True), ("timestamp", "varchar(8)", False), ("x", "x", True),
        ("boolean", "tinyint", True), ("nchar", "char", True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select("want", types.types_compatible(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_type_similarity(spark):
    pairs = [
        ("varchar", " VARCHAR", 1.0), ("varchar", "nvarchar", 0.9), ("varchar(10)", "varchar", 0.2), ("", "int", 0.5),
        ("int", None, 0.5), ("int", "number", 0.9), ("int", "float", 0.2), ("date", "datetime2", 0.9), ("bool", "bit", 0.9),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    rows = df.select("want", types.type_similarity(F.col("a"), F.col("b")).alias("got"), types.types_equivalent(F.col("a"), F.col("b")).alias("same")).collect()
    assert all(r.got == r.want and r.same == (r.want >= 0.9) for r in rows)


def test_python_number_text(spark):
    rng = random.Random(1)
    values = [12.35, 98.65, 6.25, 97.05, 0.5, 1.5, 2.5, 1234567.891, 0.0] + [rng.uniform(0, 5000) for _ in range(300)]
    for digits in (0, 1, 2):
        assert column(spark, values, lambda c: text.fixed(c, digits), "double") == [f"{v:.{digits}f}" for v in values]
    shares = [rng.random() for _ in range(200)]
    assert column(spark, shares, text.percent, "double") == [f"{v:.1%}" for v in shares]
    assert column(spark, values, lambda c: text.rounded(c, 1), "double") == [round(v, 1) for v in values]
