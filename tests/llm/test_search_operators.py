"""Vector codes, vector search and lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lexical_search, vector_codes, vector_search

NAN = float("nan")


def vectors(spark, rows, extra=False):
    rows = [(*r, k, "x") for k, r in enumerate(rows)] if extra else rows
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + (", region int, `a.b` string" if extra else ""))


def random_rows(n, dims=16, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in rng.normal(size=dims).astype(np.float32)], int(k % 3)) for k in range(n)]
    return rows + [(n + k, rows[7][1], None) for k in range(copies)]


ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [NAN] * 16, 1), (903, [math.inf] * 16, 2), (905, [], 2)]


# --- vector codes -------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry, in Python's integers."""
    dims = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    size = dims // parts
    whole = {k: [math.floor(1024 * x) for x in v] + [0] * (dims - len(v)) for k, v, _ in rows}
    cut = lambda k, p: whole[k][p * size : (p + 1) * size]
    books = [[cut(k, p) for k in sorted(whole)[:entries]] for p in range(parts)]

    def nearest(x, book):
        found = [(sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book)]
        return min(found)

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for k in whole:
                groups.setdefault(nearest(cut(k, p), book)[1], []).append(cut(k, p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(book)]
    out = {}
    for k in whole:
        found = [nearest(cut(k, p), books[p]) for p in range(parts)]
        out[k] = "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_brute_force(spark, entries):
    rows = random_rows(60, copies=30)
    want, sha = plain_codes(rows + [(905, [], 2)], entries=entries)
    table = vectors(spark, rows + ODD, extra=True).repartition(3)
    books = vector_codes.fit(table, entries=entries)
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.encode(table, books).collect()}
    assert got == want and vector_codes.digest(books) == sha


def test_cells_lose_no_entry():
    rng = np.random.default_rng(3)
    for dims, spread in ((1, 3), (5, 40), (16, 900), (16, 1)):
        entries = rng.integers(-spread, spread + 1, (40, dims))
        parts = np.concatenate([rng.integers(-3 * spread, 3 * spread + 1, (500, dims)), entries, np.full((2, dims), vector_codes.LARGEST)])
        index, error = vector_codes.CellMemo(entries).nearest(parts)
        exact = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


def test_cells_are_remembered_and_skip_entries():
    rng = np.random.default_rng(4)
    entries = rng.normal(0, 1000, (256, 16)).astype(np.int64)
    memo = vector_codes.CellMemo(entries)
    near = entries[rng.integers(0, 256, 2000)] + rng.integers(-40, 41, (2000, 16))
    memo.nearest(near)
    cells = memo.counts["cells"]
    memo.nearest(near)
    assert memo.counts["cells"] == cells and memo.counts["measured"] < 0.1 * 256 * memo.counts["parts"]


def test_codes_of_empty_and_unusable_tables(spark):
    for rows in ([], ODD[:4]):
        table = vectors(spark, rows)
        books = vector_codes.fit(table)
        assert vector_codes.encode(table, books).count() == 0


def test_decoded_vectors_are_close_where_every_vector_is_an_entry(spark):
    rows = random_rows(40)
    table = vectors(spark, rows)
    books = vector_codes.fit(table)
    coded = vector_codes.decode(vector_codes.encode(table, books), books).collect()
    assert all(abs(a - b) <= 1 / 1024 for r in coded for a, b in zip(r.vec, rows[r.vec_id][1], strict=True))


# --- vector search ------------------------------------------------------------------------------------------------------


def plain_search(rows, nearest, every):
    usable = [(k, v) for k, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % every:
            continue
        found = [(-float(vector_search.products(np.array([v]), np.array([w]))[0]), k) for k, w in usable if k != q]
        out[q] = [(k, -s) for s, k in sorted(found)[:nearest]]
    return out


def result(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("rows_a_root", [1, 64])
def test_factor_one_is_exact(spark, rows_a_root):
    rows = random_rows(700, copies=150) + ODD + [(906, [0.0] * 16, 1), (908, [0.001] * 16, 1)]
    table = vectors(spark, rows, extra=True).repartition(5)
    got = result(vector_search.search(table, nearest=10, every=20, factor=1.0, sample=256, rows_a_root=rows_a_root))
    assert got == plain_search(rows, 10, 20)


def test_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (1, [0.5, 0.5], 1), (None, [3.0, 3.0], 1)]
    got = result(vector_search.search(vectors(spark, rows), factor=1.0))
    assert got == {0: [(1, 0.5)]}
    assert vector_search.search(vectors(spark, [])).count() == 0


def test_relaxed_search_recalls_most(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = result(vector_search.query(spark, sf_dir))
    want = plain_search(rows, vector_search.NEAREST, vector_search.EVERY)
    same = sum(len({k for k, _ in got[q]} & {k for k, _ in found}) for q, found in want.items())
    assert same >= 0.95 * sum(map(len, want.values()))


# --- lexical search -----------------------------------------------------------------------------------------------------


def plain_terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_ranking(docs, items, places=20):
    texts = [(k, t) for k, t in ((k, plain_terms(t)) for k, t in docs) if t]
    n, length = len(texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    asked = {}
    for k, t in items:
        asked.setdefault(k, []).extend(plain_terms(t))
    out = {}
    for item, words in asked.items():
        found = []
        for k, t in texts:
            tf, m = Counter(t), 100 - 25 + (25 * len(t) * n) // length
            score = sum(weight[w] * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in words if w in tf)
            if score > 0:
                found.append((-score, k is None, k))
        out[item] = [(k, -s) for s, _, k in sorted(found)[:places]]
    return {k: v for k, v in out.items() if v}


def lexical(spark, docs, items, **limits):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n int, `a.b` string").repartition(3)
    items = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, term int")
    out = {}
    for r in sorted(lexical_search.search(docs, items, **limits).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


ODD_DOCS = [(None, "alpha beta"), (901, None), (902, ""), (903, "--- !!"), (904, "ALPHA ÜnderÄ x" * 3000), (5, "alpha"), (5, "alpha")]
ODD_ITEMS = [(1, "alpha alpha beta the"), (1, "gamma"), (2, None), (3, ""), (4, "nowhere"), (None, "the ÜnderÄ"), (6, "the of and alpha"), (7, "rare7 the")]


@pytest.mark.parametrize("places", [3, 20])
@pytest.mark.parametrize("block_terms", [4, 1 << 18])
def test_ranking_equals_brute_force(spark, monkeypatch, places, block_terms):
    rng = np.random.default_rng(5)
    common = ["the", "of", "and", "alpha", "beta", "gamma"]
    docs = [(int(k), " ".join([*rng.choice(common, rng.integers(1, 40)), f"rare{k % 50}"])) for k in range(900)] + ODD_DOCS
    assert lexical(spark, docs, ODD_ITEMS, places=places, block_terms=block_terms) == plain_ranking(docs, ODD_ITEMS, places)


def test_optional_lists_leave_no_document_out():
    """Windows searched with every least score agree with the whole ranking above it."""
    rng = np.random.default_rng(6)
    weight = rng.integers(0, 4000, 30)
    owner = np.sort(rng.integers(0, 2000, 20000))
    term = np.minimum(29, rng.geometric(0.2, 20000) - 1)
    pairs = np.unique(np.stack([owner, term], axis=1), axis=0)
    window = lexical_search.Postings(np.arange(2000), rng.integers(75, 200, 2000), pairs[:, 0], pairs[:, 1], rng.integers(1, 9, len(pairs)), weight)
    item, times = np.arange(0, 30, 2), rng.integers(1, 4, 15)
    every, score = window.search(item, times, 1)
    for least in np.quantile(score, [0.1, 0.5, 0.9, 0.99, 1.0]).astype(int).tolist():
        found, got = window.search(item, times, least)
        assert dict(zip(found.tolist(), got.tolist(), strict=True)) == {d: s for d, s in zip(every.tolist(), score.tolist(), strict=True) if s >= least}


def test_ranking_of_empty_tables(spark):
    assert lexical(spark, [], ODD_ITEMS) == {} and lexical(spark, ODD_DOCS, []) == {}
