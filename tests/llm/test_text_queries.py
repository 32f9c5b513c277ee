"""Check SQL, shape and pipeline of the text queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, database
from plumbline.llm import line_dedup, near_dedup, quality_rules
from plumbline.llm.queries import ORACLES, QUERIES
from test_free_operators import near_classes


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir).toPandas(), database(sf_dir).execute(ORACLES[name]).df()).startswith("ok")


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = {r.doc_id: r.failures for r in quality_rules.ledger(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if not ledger[r.doc_id] & quality_rules.mask(quality_rules.CURRENT))
    rows = [(k, t) for (k, _), t in zip(rows, line_dedup.brute_force(rows), strict=True)]
    rows = [(k, t) for k, t in rows if t.split()]
    named = near_classes(rows)
    want = sorted({named[k] for k, _ in rows})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({r.doc_id for r in got}) == want
    room = {}
    for r in got:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_leave_clashing_columns_alone(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    own = ["words", "lines", "n_lines", "n_words", "failures", "n_removed", "bucket", "a.b", "g", "k"]
    docs = plain.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in own])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = {r.doc_id: r for r in stage(spark, plain, sf_dir).collect()}
        rows = stage(spark, docs, sf_dir)
        assert rows.columns == docs.columns
        for r in rows.collect():
            assert (r.text, r.n_chars, r.lang) == (want[r.doc_id].text, want[r.doc_id].n_chars, want[r.doc_id].lang)
            assert [r[c] for c in own] == [f"{c} {r.doc_id}" for c in own]
            del want[r.doc_id]
        assert not want


def test_near_dedup_words_ignore_case_and_marks():
    assert near_dedup.words_of_text("A, b!") == near_dedup.words_of_text("a b")
