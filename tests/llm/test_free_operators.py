"""Line dedup, extraction, packing, coding, archives and near duplicates against plain versions on small tables."""

import base64
import hashlib
import html
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, html_text, line_dedup, near_dedup, packing, warc
from plumbline.llm.common import written
from plumbline.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("min_words", [5, 9, 50])
def test_line_dedup_equals_brute_force(spark, min_words):
    random.seed(min_words)
    lines = ["a b", "c", "d e f", "g h i j k l", "m", "n o", "", "  ", "p q r s t u v w x y z " * 3]
    rows = [(k, "\n".join(random.choice(lines) for _ in range(random.randrange(25)))) for k in range(40)]
    for k in range(15):
        a, b = random.choice(rows)[1].split("\n"), random.choice(rows)[1].split("\n")
        rows.append((100 + k, "\n".join([*a[random.randrange(len(a)) :], *b[: random.randrange(len(b) + 1)], f"u{k}"])))
    rows += [(200, None), (201, "\n".join(["same x"] * 70)), (202, "\n".join(["same x"] * 64)), (None, "p q r s t u v w x y z " * 3)]
    df = frame(spark, rows).withColumns({"n_lines": F.lit("mine"), "tie": F.lit("mine")})
    got = {r.doc_id: r for r in line_dedup.dedup(df, min_words=min_words).collect()}
    want = line_dedup.brute_force([(-1 if k is None else k, t) for k, t in rows], min_words)
    assert {k: got[k].text for k, _ in rows} == {k: w for (k, _), w in zip(rows, want, strict=True)}
    assert {r.tie for r in got.values()} == {"mine"}


def test_line_dedup_of_documents_and_repeated_rows(spark, documents):
    rows = documents[:80]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert [got[k] for k, _ in rows] == line_dedup.brute_force(rows)
    twice = frame(spark, [(1, "a b c " * 30), (1, "a b c " * 30), (2, "a b c " * 30 + "\nq")])
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.dedup(twice).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.dedup(twice.limit(0)).count() == 0


def test_suffixes_are_ranked_in_order(spark):
    rows = [(k, "\n".join(t)) for k, t in enumerate(["abcabc", "bcab", "abca", "zzzzz"])]
    lines = line_dedup.line_table(frame(spark, rows), min_words=4)
    ids = {(r.dedup_key, r.pos): (r.h1, r.h2) for r in lines.collect()}
    for level, table in enumerate(line_dedup.suffix_ranks(lines, 4)):
        ranked = table.collect()
        start = {(r.dedup_key, r.pos): tuple(ids[r.dedup_key, r.pos + i] for i in range(2**level)) for r in ranked}
        order = sorted(ranked, key=lambda r: r["rank"])
        assert [start[r.dedup_key, r.pos] for r in order] == sorted(start.values())
        assert min(Counter(start.values()).values()) > 1


def test_extraction_gives_the_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        page = source[r.page_id]
        body = re.sub("<[^>]*$", "", page.partition("<article>")[2].partition("</article>")[0])
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a>
<p>The site slogan is a long sentence here, really.</p></header><nav><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your experience on this site, please accept them all.</p></div>
<div id="content"><h1>Headline of it all</h1><p>First   paragraph with some &lt;words&gt; and a <a href=x>link</a> in it, it goes on.<br>More text<p>Short.
<div class="ad-slot">Buy now! The best product of the whole wide world is here for you.</div><p>Second paragraph has more words than the first one.</div>
<form action=x><label>Your name</label><input><button>Send</button></form><aside><p>Sidebar text that is long enough to look like content.</p></aside>
<section id="comments"><article class="comment"><p>I liked this article very much, thank you for writing it all.</p></article></section>
<footer>&copy; 2020 <p>All rights</footer><script>if(a<b){x="</p>"}</script></body></html><p"""


def test_extraction_of_other_pages(spark):
    want = "Headline of it all\nFirst paragraph with some <words> and a link in it, it goes on. More text\nShort.\nSecond paragraph has more words than the first one."
    assert html_text.main_text(PAGE) == want
    odd = [None, "", "<", "<p", "a<b", "<script>", "<!--", "<" * 3000, '<a "' * 2000, "<div>" * 2000 + "x"]
    rows = spark.createDataFrame([(k, "u", p) for k, p in enumerate(odd)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(rows).collect()} == {""} and html_text.extract(rows.limit(0)).count() == 0


LONG = "This paragraph tells the story at length and has no links at all, " * 4 + "as a real article does."


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='layout has-sidebar'>", "<div class='page with-header'>", "<div class='no-sidebar'>", "<form action=x>", "<div class='sidebar'>",
     "<div class=widget><div class='entry-content'>", "<div class=widget><div role=main>"],
)
def test_name_of_a_wrapper_does_not_lose_the_article(wrapper):
    page = f"<body>{wrapper}<p>{LONG}</p><p>{LONG}</p></div></form></body>"
    assert html_text.main_text(page) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("wrapper", ["<aside>", "<section class=related>", "<section id=comments>"])
def test_article_in_boilerplate_is_none(wrapper):
    main = f"<main><p>{LONG}</p></main>"
    assert html_text.main_text(f"<body>{main}{wrapper}<article><p>Another story of the site, told in a few words.</p></article></body>") == LONG


MANY = "Everyone who reads this part of the page will find that it goes on for very long, as such parts sometimes do, you see. " * 9
PARTS = [
    "<div class=comment>", "<section id=comments><div>", "<div class='cookie-consent'>", "<div class=ad>", "<div class='advert banner'>", "<div class=sidebar>",
    "<aside>", "<section class=related>", "<form action=x>", "<div class='site-notice'>", "<div class=newsletter>", "<div role=dialog>", "<div class=widget>",
]


@pytest.mark.parametrize("article", ["<article>", "<main>", "<div class='entry-content'>", "<div>"])
@pytest.mark.parametrize("part", PARTS)
def test_long_boilerplate_stays_out(part, article):
    end = "".join(f"</{name}>" for name in reversed(re.findall("<([a-z]+)", part)))
    close = f"</{article[1:-1].split()[0]}>"
    other = f"{part}<p>{MANY}</p>{end}"
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    want = f"{LONG}\n{LONG}"
    for page in (f"{other}{article}{text}{close}", f"{article}{text}{close}{other}", f"{article}<p>{LONG}</p>{other}<p>{LONG}</p>{close}"):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == want


def test_hidden_inline_text_is_dropped():
    page = "<article><p>The story begins here <span hidden>secret words</span> and <b style='display:none'>more</b>goes on <i class=x>in full</i>.</p></article>"
    assert html_text.main_text(page) == "The story begins here and goes on in full."


def test_long_block_null_url_and_clashing_columns(spark):
    text = "word " * 400_000
    rows = [(1, None, f"<article><p>{text}</p></article>", "x", 3), (None, "u", "<main><p>A text of some words, here.</p></main>", None, 4), (1, None, None, "y", 5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(html_text.extract(table).collect(), key=lambda r: -r.n_chars)
    assert [(r.page_id, r.url, r.text) for r in got] == [(1, None, text.strip()), (None, "u", "A text of some words, here."), (1, None, "")]


def test_minimum_cut_equals_brute_force():
    random.seed(2)
    for _ in range(300):
        n = random.randrange(1, 9)
        scores = [random.randrange(-6, 7) / 2 for _ in range(n)]
        edges = [(a, b, random.choice([0.5, 1.0, 1.5])) for a in range(n) for b in range(a) if random.random() < 0.4]

        def cost(labels, scores=scores, edges=edges):
            own = sum(max(-s, 0) if x else max(s, 0) for s, x in zip(scores, labels, strict=True))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert cost(html_text.minimum_cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def random_texts():
    random.seed(1)
    letters = [chr(c) for c in range(0x20, 0x7F)] * 3 + [chr(c) for c in range(0xA0, 0x250)]
    letters += list("\n\t\r\x0b\x0c\x1c\x1f\x85 　²½Ⅳ٣一̀\U0001f600‍﻿\x00") * 8
    letters += ["'s", "'re", "<|endoftext|>", "<|endoftext|", "the", "ing", "hello"] * 15
    letters = [x for x in letters if len(x) > 1 or unicodedata.category(x) != "Cn"]
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(4000)]
    return [*texts, "", "a" * 3000, " " * 50, "\n\n  x", "thethe" * 900, "ab" * 700 + "x"]


def test_coder_equals_the_library(library, documents):
    texts = random_texts() + [t for _, t in documents]
    coder = bpe.coder()
    ids = coder.encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(a, "<u4").tolist() == b.ids for a, b in zip(ids, want, strict=True))
    assert all(coder.decode(a) == library.decode(b.ids, skip_special_tokens=False) for a, b in zip(ids, want, strict=True))


def test_merging_many_words_equals_merging_each():
    coder, words = bpe.coder(), [w.encode() for t in random_texts()[:500] for w in t.split()] + [b"ab" * 400]
    ids, lengths = coder.merge_many(words)
    ends = np.cumsum(lengths)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [coder.merge(w) for w in words]


def test_coding_query(spark, sf_dir, library, documents):
    got = {r.doc_id: r for r in bpe.query(spark, sf_dir).collect()}
    for k, t in documents:
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    odd = frame(spark, [(1, None), (2, ""), (None, "abc"), (2, "")]).withColumn("ids", F.lit("mine"))
    assert [r.decoded for r in bpe.decode(bpe.encode(odd)).collect()] == ["", "", "abc", ""] and bpe.encode(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n, kind", [(0, "text"), (3, "text"), (1000, "text"), (20000, "text"), (3000, "middle")])
def test_packing_covers_the_histogram(n, kind):
    rng = np.random.default_rng(n)
    lengths = np.minimum(rng.lognormal(6.3, 1.0, n).astype(int) + 1, 2048) if kind == "text" else rng.integers(500, 1500, n)
    counts = np.bincount(lengths, minlength=2049)
    groups, held = packing.packed(counts, 2048), np.zeros(2049, int)
    for config, times in groups:
        assert sum(config) <= 2048
        for x in config:
            held[x] += times
    used, least = sum(t for _, t in groups), -(-int(lengths.sum()) // 2048)
    assert (held == counts).all() and used <= least * (1.002 if kind == "text" else 1.05) + 1


def test_packing_query(spark, sf_dir, library, documents, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rows = packing.query(spark, sf_dir).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append(r)
    for k, t in documents:
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for n, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 2048 or n == 0
            at += r.length
        assert at == len(ids)
    for held in places.values():
        held.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in held])
        assert [r.offset for r in held] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_packed_sequences_hold_the_ids(spark, library):
    rows = [(1, "one two three"), (2, None), (3, "four " * 5000), (3, "four " * 5000), (None, "")]
    packed = packing.pack(written(packing.cut(frame(spark, rows), capacity=64, with_ids=True), "pieces"), capacity=64)
    total = sum(len(r.ids) // 4 for r in packing.sequences(packed).collect())
    assert total == sum(len(library.encode(t or "").ids) + 1 for _, t in rows)
    assert packing.pack(written(packing.cut(frame(spark, rows).limit(0)), "pieces")).count() == 0


@pytest.mark.parametrize("range_bytes", [100, 777, 1 << 20])
def test_archives_round_trip(spark, range_bytes):
    rows = [(k, f"http://x/ü {k}\n", ["same", None, "", f"u{k}", "long " * 50000][k % 5]) for k in range(60)]
    rows += [(3, None, "u3"), (None, "q", "same"), (None, "q", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    manifest = warc.write_archives(warc.with_revisits(pages.repartition(3)))
    got = warc.read_archives(spark, manifest, range_bytes).select("*", warc.page_key("record_id").alias("k"), warc.page_key("refers_to").alias("r")).collect()
    first = {}
    for k, _, page in rows:
        first[page or ""] = min(first.get(page or "", 10**6), 10**6 if k is None else k)
    want = Counter((k, len((p or "").encode()), first[p or ""] if first[p or ""] < 10**6 and k != first[p or ""] else None) for k, _, p in rows)
    assert Counter((r.k, r.payload_bytes, r.r) for r in got) == want
    for r in got:
        assert (r.record_type == "response") == (r.payload is not None)
        if r.payload is not None:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() and len(r.payload) == r.payload_bytes
    assert warc.read_archives(spark, warc.write_archives(warc.with_revisits(pages.limit(0)))).count() == 0


def test_reader_ignores_what_only_looks_like_a_record(tmp_path):
    import pyarrow as pa

    records = [warc.record(k, "u", bytes([31, 139, 8]) * k + b"x" * k) for k in range(30)]
    junk = b"\x1f\x8b\x08 not a member" + zlib.compress(b"no") + b"\x1f\x8b"
    data = junk.join(records)
    (tmp_path / "a").write_bytes(data)
    with pa.OSFile(str(tmp_path / "a")) as source:
        for size in (1, 50, 1000):
            found = [m for s in range(0, len(data), size) for m in warc.records_from(source, s, min(len(data), s + size))]
            assert [warc.parsed(m)[0] for m in found] == [f"<urn:x-page:{k}>" for k in range(30)]


def near_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        words = near_dedup.words_of_text(text)
        size = min(5, len(words))
        sets.append(Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        either = sum((sets[a] | sets[b]).values())
        if not either or sum((sets[a] & sets[b]).values()) / either >= threshold:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(doc_id)
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("stars", [1, 3])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, stars):
    monkeypatch.setattr(near_dedup, "STARS", stars)
    monkeypatch.setattr(near_dedup, "PAIRS_A_COPY", 8)
    random.seed(5)
    rows = [(k, t) for k, t in documents if len(t) < 3000][:120]
    bases = [t for _, t in documents if 60 < len(t.split()) < 200][:2]
    for k in range(80):
        words = bases[k % 2].split()
        for _ in range(random.randrange(1, 4)):
            words[random.randrange(len(words))] = f"zz{random.randrange(1000)}"
        rows.append((2000 + k, " ".join(words)))
    rows += [(3000, None), (3001, ""), (3002, "..."), (3003, "a b"), (3004, "A, b!"), (3005, "a c")]
    want = near_classes(rows)
    df = frame(spark, rows).withColumn("k", F.lit("mine"))
    assert {r.k: r.root.k for r in near_dedup.classes(df).collect()} == want
    kept = near_dedup.first_of_each(df).collect()
    assert {r.doc_id for r in kept} == set(want.values()) and {r.k for r in kept} == {"mine"}


def test_near_duplicates_of_odd_rows(spark):
    df = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "x"), (2, "x")])
    assert sorted((r.doc_id or 0) for r in near_dedup.first_of_each(df).collect()) == [0, 1]
    assert near_dedup.classes(df.limit(0)).count() == 0 and near_dedup.first_of_each(df.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng, errors = np.random.default_rng(2), []
    for t in range(30):
        n = int(rng.integers(20, 300))
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        a = rng.integers(0, 9, n)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 9, n))
        if t % 3 == 0:
            a, b = (a > 0) * 1, (b > 0) * 1
        one, other = near_dedup.signatures([(hashes[a > 0], a[a > 0]), (hashes[b > 0], b[b > 0])], 2048)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append(((one == other).mean() - true) / np.sqrt(true * (1 - true) / 2048))
    assert abs(np.mean(errors)) < 0.75 and 0.6 < np.std(errors) < 1.5


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 102), (60, 200), *[(200, k) for k in range(300, 360)]]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {100: 100, 101: 100, 60: 60, 200: 60} | {k: 60 for k in range(300, 360)}
    assert got == want
