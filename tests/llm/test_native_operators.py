"""Sharding, license rules, fingerprints and quality rules against plain versions on small tables."""

import hashlib
import re
import time
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import fingerprints, license_rules, queries, quality_rules, sharding

ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "mit license"), (4, "x " * 30), (4, "x " * 30), (5, "Ünï cödé words. " * 3), (6, "long " * 20000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"size": F.lit("mine"), "n_words": F.lit("mine"), "extra": F.lit(7)})


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_shards_obey_the_key_law(spark, docs):
    rows = sharding.assign(docs, 5, bucket_bytes=20_000).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((r.text or "").encode()) + 8 and r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(5))
    grown = {r.doc_id: r.shard for r in sharding.assign(docs, 6, bucket_bytes=20_000).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)
    part = {r.doc_id: r.shard for r in sharding.assign(docs.filter("doc_id % 3 = 0"), 5).collect()}
    assert all(part[r.doc_id] == r.shard for r in rows if r.doc_id in part)
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in in_order if r.shard == 0]
    assert ids != sorted(ids)


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.assign(odd, 3).collect()
    assert len(rows) == len(ODD) and {r.extra for r in rows} == {7} and all(isinstance(r.size, int) for r in rows)
    assert sharding.assign(odd.limit(0), 3).count() == 0
    crc = {(r.doc_id, r.text_crc32) for r in rows_with_crc(odd)}
    assert (3, zlib.crc32(b" \n\t")) in crc


def rows_with_crc(df):
    return df.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")).collect()


def test_sharding_query_gives_what_the_files_hold(spark, sf_dir, docs):
    """Law, sizes and sums of the registered query against the table itself."""
    rows = queries.QUERIES["op1_sharding"](spark, sf_dir).collect()
    want = sorted((k, len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts(docs).items())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want and {r.law for r in rows} == {"key"}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    plain = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(docs, 24).collect()}
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == plain


def test_shards_keep_the_callers_columns(spark, docs):
    own = ["bucket", "first_slot", "permutation", "row_in_bucket", "a.b"]
    rows = sharding.assign(docs.limit(30).select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in own]), 3).collect()
    assert all([r[c] for c in own] == [f"{c} {r.doc_id}" for c in own] for r in rows) and len(rows) == 30


def plain_sketch(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").lower()) if w]
    runs = [words[k : k + 5] for k in range(len(words) - 4)] or ([words] if words else [])
    hashes = set()
    for run in runs:
        h = 42
        for word in run:
            h = xxhash.xxh64_intdigest(word.encode(), seed=h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    low = sorted(h for h in hashes if h < -(1 << 63) + (1 << 64) // fingerprints.SHARE)
    return low or sorted(hashes)[:1]


def plain_likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_fingerprint_query_equals_brute_force(spark, sf_dir, docs):
    rows = sorted(texts(docs).items(), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    for (k, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        mine, other = plain_sketch(text), plain_sketch(edited)
        assert got[k].fingerprint == "".join(f"{h % (1 << 64):016X}" for h in mine)
        assert got[k].edited_fingerprint == "".join(f"{h % (1 << 64):016X}" for h in other)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(text)
        assert got[k].near_edited == pytest.approx(plain_likeness(mine, other)) and got[k].near_next == pytest.approx(plain_likeness(mine, plain_sketch(following)))


def test_next_of_null_keys_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "a", "p"), (None, "b", "q")], "doc_id long, text string, next_part string").withColumn("sketch_words", F.lit(3))
    got = fingerprints.with_next(fingerprints.with_sketch(rows, "text", "s"), {"following": F.col("text")}).collect()
    assert {(r.text, r.following) for r in got} == {("a", "b"), ("b", "a")}
    assert {(r.text, r.next_part, r.sketch_words) for r in got} == {("a", "p", 3), ("b", "q", 3)}


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    sharding.write_shards(sharding.assign(docs, 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_license_rules_equal_brute_force(spark, docs, odd):
    cases = [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the MIT License. Licensed under CC BY-NC 4.0. x under the mit license",
        "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy. MIT License mit license",
        "CC BY NC cc by nc sa CC BY nc",
        "SPDX-License-Identifier: MIT\nlicense: bsd",
        "https://creativecommons.org/licenses/by-sa/4.0/ licence",
        "all rights reserved. K licenſe",
        "x " * 500 + "mit license " * 200,
    ]
    rows = [(1000 + k, t) for k, t in enumerate(cases)]
    rows += [(r.doc_id, r.text) for r in docs.collect() if re.search("licen|cc by", r.text or "", re.I)]
    rows += [(2000 + k, t) for k, (_, t) in enumerate(ODD)]
    want = dict(rows)
    for r in license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        detections, labels = license_rules.brute_force(want[r.doc_id])
        assert [(d.start, d.end, d.label) for d in r.detections] == detections and r.labels == labels
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in want[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted(i for p in license_rules.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None)) and 0 <= r.score <= 1


def test_rules_contain_their_literals():
    rules = license_rules.rules()
    assert len(rules) > 200 and [r["rank"] for r in rules] == list(range(len(rules)))
    assert all(any(g in r["literal"] or "licen" in r["literal"] or "spdx" in r["literal"] for g in license_rules.GATES) for r in rules)


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 16)
    rows = {r.doc_id: r for r in queries.QUERIES["op5_fingerprints"](spark, SfDir(spark, docs)).collect()}
    text = texts(docs)
    ids = sorted(text, reverse=True)
    errors = []
    for k, doc_id in enumerate(ids):
        own, following = text[doc_id], text[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(own), shingles(edited)
        if len(a) > 200:
            errors.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.05


class SfDir(str):
    """The folder of the tables, as the queries take it."""

    def __new__(cls, spark, docs):
        return super().__new__(cls, docs.inputFiles()[0].rsplit("/", 1)[0])


def test_sketches_merge_and_compare(spark):
    whole = " ".join(f"w{k}" for k in range(4000))
    rows = [(1, whole), (2, " ".join(whole.split()[:400])), (3, whole), (4, ""), (5, None), (6, "a b")]
    df = fingerprints.with_sketch(spark.createDataFrame(rows, "doc_id long, text string"), "text", "sketch")
    got = {r.doc_id: r.sketch for r in df.collect()}
    assert got[1] == got[3] and set(got[2]) <= set(got[1]) and got[4] == got[5] == [] and len(got[6]) == 1
    assert abs(len(got[1]) / (3996 / fingerprints.SHARE) - 1) < 0.2
    pair = df.filter("doc_id = 2").select(F.col("sketch").alias("a")).crossJoin(df.filter("doc_id = 1").select(F.col("sketch").alias("b")))
    found = pair.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert found.c == 1.0 and found.m == got[1]


def test_next_document_of_odd_keys(spark):
    rows = [(1, "a b c"), (None, "x y"), (1, "a b c"), (3, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("mine"))
    got = sorted((r.doc_id or 0, str(r.text), str(r.following)) for r in fingerprints.with_next(df, {"following": F.col("text")}).collect())
    assert got == sorted([(3, "None", ""), (2, "", "a b c"), (1, "a b c", "a b c"), (1, "a b c", "x y"), (0, "x y", "None")])
    assert fingerprints.with_next(df.limit(0), {"following": F.col("text")}).count() == 0


def measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, odd):
    rows = docs.collect() + [r for r in odd.collect() if r.doc_id not in (None, 4)]
    got = quality_rules.ledger(spark.createDataFrame([(k, r.text, "mine") for k, r in enumerate(rows)], "doc_id long, text string, n_words string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text or "")


def test_policies_and_ablation_read_the_same_bits(spark, docs):
    rows = quality_rules.ledger(docs).select("doc_id", "failures").collect()
    for r in quality_rules.ablation(spark.createDataFrame(rows)).collect():
        mask, bit = quality_rules.mask(r.policy), 1 << quality_rules.BIT[r.rule]
        assert r.kept == sum(not x.failures & mask for x in rows)
        assert r.kept_without == sum(not x.failures & mask & ~bit for x in rows)
        assert r.failed == sum(bool(x.failures & bit) for x in rows)
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    assert kept == {x.doc_id for x in rows if not x.failures & quality_rules.mask(quality_rules.CURRENT)}


def test_clean_documents_stay(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality_rules.ledger(docs).withColumn("kept", quality_rules.passes()).join(labels, "doc_id").filter("n_words >= 20")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2


@pytest.mark.parametrize("name", ["op1_sharding", "op2_license_scan", "op5_fingerprints", "op10_quality_rules"])
def test_plan_is_native(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert node not in plan


def test_many_detections_take_time_in_proportion(spark):
    """50 000 detections in one text; the same text a few times shorter against brute force over all pairs."""
    notice = "Licensed under the MIT license. Words between the notices, Apache License version 2. "
    few = spark.createDataFrame([(1, notice * 400)], "doc_id long, text string")
    found = license_rules.scan(few).select("detections", "labels").first()
    want, labels = license_rules.brute_force(notice * 400)
    assert [(x.start, x.end, x.label) for x in found.detections] == want and found.labels == labels and len(want) > 2 * license_rules.CHUNK
    each = len(want) / 400
    many = spark.createDataFrame([(1, notice * int(50_000 / each))], "doc_id long, text string")
    begin = time.time()
    n = license_rules.scan(many).select(F.size("detections").alias("n")).first().n
    assert abs(n - 50_000) <= each and time.time() - begin < 60
