"""Ranked lexical search: accumulators for short lists, document-at-a-time skipping for long ones.

Documents are counted once: the number of all terms of each, and how often each holds the terms that any item asks for. That
forward table is stored; the sums over it (documents, terms, documents per term) are the statistics of the whole corpus.
Then every task turns windows of its documents into posting lists, each with the greatest contribution of the window, and
searches every item in them:

* the short lists of the item are added up term at a time into accumulators, which then are one more list, with a bound;
* lists, that one included, are ordered by bound. Those whose bounds together cannot reach the score of the item's last place
  so far are optional. Only documents of the other lists are candidates; the optional lists are asked for candidates alone,
  from the highest bound down, and a candidate leaves as soon as what is left cannot lift it to that score.

Windows grow from small ones, so that the scores of the last places rise early. A task gives its best per item, and the best
of all tasks are merged; no posting is shuffled, so a term that every document holds is no hot key. Items are dealt into
blocks of about ITEM_TERMS distinct terms, which bounds what is broadcast; there is one pass over the documents per block.

Defined cases: null and empty texts have no terms; such a document counts nowhere, such an item has no result; rows of one
item_id (null included) are one item with the terms of all; each row of the documents is a document of its own, also with a
repeated doc_id; a null doc_id comes last among equal scores; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, written

PLACES = 20
ITEM_TERMS = 1 << 18
SHORT = 16  # a list is short if it has less than one in so many documents of the window
FIRST_WINDOW = 256
WINDOW = 8192
SLICE_BYTES = 8 << 20
NO_ID = (1 << 63) - 1
# ASCII letters (as small ones), digits and all bytes above ASCII are parts of terms, the rest separates them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def terms_of(text: Column) -> Column:
    """The same as an array column."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(text, capitals, capitals.lower()), _SEPARATORS), "")


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES each."""
    ends = np.cumsum([len(x) for x in column])
    cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True)


def counted(docs: DataFrame, vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, term, tf) per document with a term: all its terms, and the numbers and counts of those in ``vocabulary``.

    ``vocabulary`` is a broadcast dictionary from terms to numbers from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        size, get = max(1, len(number)), number.get
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                words = [terms(t) for t in texts[a:b]]
                n = np.fromiter(map(len, words), np.int64, len(words))
                flat = np.fromiter((x for w in words for x in map(get, w, repeat(-1))), np.int64, int(n.sum()))
                place = np.repeat(np.arange(len(words)), n) * size + flat
                distinct, tf = np.unique(place[flat >= 0], return_counts=True)
                kept = np.flatnonzero(n)
                ends = np.concatenate([[0], np.searchsorted(distinct, (kept + 1) * size)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (distinct % size, tf)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(kept)), pa.array(n[kept]), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_of(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms; every task sends one row per term it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for row in forward.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).head(size):
        out[row["term"]] = row["df"]
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Postings:
    """Posting lists of some documents: per term the documents, their contributions, and the greatest of these."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")  # documents ascend within a term
        self.doc_id, self.size, self.doc = doc_id, len(doc_id), owner[order]
        tf = tf[order].astype(np.int64)
        self.score = weight[term[order]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.top = np.zeros(len(weight), np.int64)
        met = np.flatnonzero(np.diff(self.start))
        if len(met):
            self.top[met] = np.maximum.reduceat(self.score, self.start[met])

    def search(self, item: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score at least ``least`` for the item's terms, and their scores."""
        bounds = times * self.top[item]
        sizes = self.start[item + 1] - self.start[item]
        short = sizes * SHORT < self.size
        total = np.zeros(self.size, np.int64)
        for k in np.flatnonzero(short & (bounds > 0)).tolist():
            at = slice(self.start[item[k]], self.start[item[k] + 1])
            total[self.doc[at]] += times[k] * self.score[at]
        # The accumulators are a list like the long ones (number -1).
        lists = [(int(bounds[k]), k) for k in np.flatnonzero(~short & (bounds > 0)).tolist()]
        lists = sorted([*lists, (int(total.max(initial=0)), -1)])
        optional, rest = 0, 0
        while optional < len(lists) and rest + lists[optional][0] < least:
            rest += lists[optional][0]
            optional += 1
        if optional == len(lists):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        needed = lists[optional:]
        accumulated = total
        if all(k >= 0 for _, k in needed):
            total = np.zeros(self.size, np.int64)
        for _, k in needed:
            if k >= 0:
                at = slice(self.start[item[k]], self.start[item[k] + 1])
                total[self.doc[at]] += times[k] * self.score[at]
        found = np.flatnonzero((total > 0) & (total + rest >= least))
        score = total[found]
        for bound, k in reversed(lists[:optional]):
            rest -= bound
            if k < 0:
                score = score + accumulated[found]
            else:
                at = slice(self.start[item[k]], self.start[item[k] + 1])
                place = np.minimum(np.searchsorted(self.doc[at], found), at.stop - at.start - 1)
                score = score + np.where(self.doc[at][place] == found, times[k] * self.score[at][place], 0)
            keep = score + rest >= least
            found, score = found[keep], score[keep]
        return found, score


class Places:
    """The best documents of an item so far."""

    def __init__(self, places: int):
        self.places, self.least = places, 1
        self.doc, self.score = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        doc, score = np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        order = np.lexsort((doc, -score))[: self.places]
        self.doc, self.score = doc[order], score[order]
        if len(order) == self.places:
            self.least = max(1, int(self.score[-1]))


def _windows(rows: int, first: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, next size) of windows that grow fourfold up to WINDOW."""
    at, size = 0, first
    while at < rows:
        yield at, min(rows, at + size), min(WINDOW, 4 * size)
        at, size = at + size, min(WINDOW, 4 * size)


def ranked(forward: DataFrame, items: list[tuple], weight: np.ndarray, documents: int, length: int, places: int = PLACES) -> DataFrame:
    """(item, doc_id, score): the best of every task for every one of ``items`` (term numbers, times)."""
    shared = forward.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best, size = [Places(places) for _ in asked], FIRST_WINDOW
        for batch in batches:
            for a, b, size in _windows(batch.num_rows, size):
                part = batch.slice(a, b - a)
                lists = part.column(2)
                owner = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                doc_id = part.column(0).fill_null(NO_ID).to_numpy()
                m = 75 + (25 * part.column(1).to_numpy() * documents) // length
                window = Postings(doc_id, m, owner, lists.flatten().to_numpy(), part.column(3).flatten().to_numpy(), weight)
                for (term, times), have in zip(asked, best, strict=True):
                    found, score = window.search(term, times, have.least)
                    if len(found):
                        have.add(doc_id[found], score)
        sizes = [len(have.doc) for have in best]
        columns = [np.repeat(np.arange(len(best)), sizes)] + [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((h.doc, h.score) for h in best), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc_id", "score"])

    return forward.mapInArrow(run, "item long, doc_id long, score long")


def _item_blocks(items: DataFrame, key: str, text: str, block_terms: int) -> Iterator[list]:
    """Rows (item_id, term, times) of all items, in blocks of whole items with about ``block_terms`` rows."""
    words = items.select(F.col(f"`{key}`").alias("item_id"), F.explode(terms_of(F.col(f"`{text}`"))).alias("term"))
    rows = written(words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")
    total = rows.count()
    blocks = -(-total // block_terms)
    for k in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "term").head(total)
        if block:
            yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    places: int = PLACES,
    block_terms: int = ITEM_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``places`` best documents of every item."""
    spark, kind = docs.sparkSession, dict(items.dtypes)[item_key]
    names = "item_id, item long, doc_id long, score long".replace("item_id,", f"item_id {kind},")
    found: list[DataFrame] = []
    for block in _item_blocks(items, item_key, item_text, block_terms):
        vocabulary = {t: k for k, t in enumerate(dict.fromkeys(r["term"].encode() for r in block))}
        forward = written(counted(docs, spark.sparkContext.broadcast(vocabulary), doc_key, doc_text), "forward")
        documents, length = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        weight = weights(frequencies(forward, len(vocabulary)), documents)
        by_item: dict = {}
        for r in block:
            by_item.setdefault(r["item_id"], []).append((vocabulary[r["term"].encode()], r["times"]))
        asked = [tuple(np.array(x, np.int64) for x in zip(*t, strict=True)) for t in by_item.values()]
        ids = spark.createDataFrame(list(zip(by_item, range(len(by_item)), strict=True)), f"item_id {kind}, item long")
        best = ranked(forward, asked, weight, documents, length, places).join(F.broadcast(ids), "item")
        found.append(best.select("item_id", "item", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], names).selectExpr("item_id", "int(item) AS rank", "doc_id", "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    rows = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)
    return rows.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op13: the 20 best documents of every benchmark item."""
    from plumbline.llm.common import table

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
