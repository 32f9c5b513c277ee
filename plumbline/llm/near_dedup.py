"""Near duplicates by BagMinHash signatures of word shingles.

A document is the multiset of its shingles. Every shingle owns a Poisson process over (time, register, weight); a document
sees the points whose weight lies below the shingle's count, and a register holds the earliest point seen. Two documents
agree in a register with the probability of their weighted Jaccard similarity. Weights are the integers, cut into the
intervals [0, 1), [1, 2), [2, 4), ..., so that a count needs as many processes as it has binary digits, and points after the
time by which every register is surely met are never made.

Signatures are cut into bands; documents that agree in a band share a bucket. Texts of equal words are one node from the
start. STARS times, all nodes of a bucket are compared, exactly, with its most central node (the one with the fullest
buckets) that has not been a centre yet, unless both are already joined; links join components. In buckets that then still
hold several components, every node outside the largest one is compared with all nodes of other components. These
comparisons are made in blocks of bounded size that count the overlaps of all their nodes at once, so that pairs are never
rows: only links leave a block. No pair that shares a bucket is left out, and a group of copies, once joined, needs about
as many comparisons as it has members.

Nodes of a hot bucket, links of a hot node and members of a hot class meet their partners salted.

Defined cases: null and wordless texts are equal to each other and to nothing else; a text of fewer than SHINGLE words is one
shingle; rows that agree in key and text are one document; a null key comes before all others and gives class null; extra
columns are kept by ``first_of_each``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, written
from plumbline.llm.components import SALTS, components, salted_join

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
ROWS = 5
BANDS = REGISTERS // ROWS
STARS = 2
PAIRS_A_COPY = 256
MOST_WORDS = 100_000
STEP_ELEMENTS = 1 << 15
QUERY_BYTES = 1 << 20
QUERIES = 128
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")
_SKETCH = "k long, tie long, g long, g2 long, bands array<long>"
NO_KEY = -(1 << 63)


class _WordHashes(dict):
    """64-bit hash of each word that a worker has met."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of_text(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> np.ndarray:
    """64-bit hash of every run of SHINGLE words."""
    if len(_hashes) > MOST_WORDS:
        _hashes.clear()
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.zeros(max(0, len(words) - size + 1) if words else 0, np.uint64)
    for k in range(size):
        total = _mixed(total + each[k : k + len(total)] + np.uint64(k + 1))
    return total


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row per multiset (distinct hashes, counts): the earliest time of each register; inf for an empty multiset.

    ``registers`` is a power of two up to 2048.
    """
    out = np.full((len(sets), registers), np.inf)
    weight = np.array([c.sum() for _, c in sets], float)
    todo, slack = np.flatnonzero(weight), 6.0
    while len(todo):
        doc = np.repeat(todo, [len(sets[k][0]) for k in todo])
        elements = np.concatenate([sets[k][0] for k in todo])
        counts = np.concatenate([sets[k][1] for k in todo]).astype(np.int64)
        until = np.zeros(len(sets))
        until[todo] = (np.log(registers) + slack) / weight[todo]
        low = 0
        while len(doc):
            _points(out, doc, elements, counts, low, until, registers)
            low = max(1, 2 * low)
            more = counts > low
            doc, elements, counts = doc[more], elements[more], counts[more]
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        slack *= 2
    return out


def _points(out: np.ndarray, doc: np.ndarray, elements: np.ndarray, counts: np.ndarray, low: int, until: np.ndarray, registers: int) -> None:
    """Points of the weight interval that starts at ``low``, up to the time ``until`` of the document."""
    width = max(1, low)
    seed = _mixed(elements + np.uint64(0x9E3779B97F4A7C15 * (low + 1) % (1 << 64)))
    time, end, step = np.zeros(len(doc)), until[doc], 0
    while len(doc):
        step += 1
        draw = _mixed(seed + np.uint64(0xD1B54A32D192ED03 * step % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / (registers * width)
        live = time <= end
        doc, seed, counts, time, end, draw = doc[live], seed[live], counts[live], time[live], end[live], draw[live]
        register = (draw & np.uint64(registers - 1)).astype(np.int64)
        place = low + (_mixed(draw) % np.uint64(width)).astype(np.int64)
        seen = place < counts
        np.minimum.at(out, (doc[seen], register[seen]), time[seen])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each signature."""
    parts = signature.view(np.uint64)[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        keys = _mixed(keys + parts[:, :, r])
    return keys.view(np.int64)


def _identity(key: str, text: str) -> tuple[Column, Column]:
    """Key (NO_KEY for null) and text hash of a row."""
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)), F.xxhash64(text_of(text))


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text hash, hash of the words (two longs) and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bpe import slices

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(batch, texts):
                words = [words_of_text(t) for t in texts[a:b]]
                groups = np.frombuffer(b"".join(xxhash.xxh128_digest(" ".join(w).encode()) for w in words), "<i8").reshape(-1, 2)
                keys = band_keys(signatures([np.unique(shingles(w), return_counts=True) for w in words]))
                flat = pa.array(keys.reshape(-1))
                # A text without words has no band.
                ends = np.concatenate([[0], np.cumsum(np.full(len(words), BANDS))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), flat)
                none = pa.array([not w for w in words])
                bands = pa.compute.if_else(none, pa.scalar(None, bands.type), bands)
                part = batch.slice(a, b - a)
                columns = [part.column(0), part.column(1), pa.array(groups[:, 0].copy()), pa.array(groups[:, 1].copy()), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "tie", "g", "g2", "bands"])
        _hashes.clear()

    k, tie = _identity(key, text)
    return docs.select(k.alias("k"), tie.alias("tie"), text_of(text).alias("text")).mapInArrow(run, _SKETCH)


def _multisets(texts: DataFrame) -> DataFrame:
    """(node, set): the sorted elements of each text's multiset, as bytes."""

    @F.pandas_udf("binary")
    def elements(text: pd.Series) -> pd.Series:
        return text.map(_elements)

    return texts.select("node", elements("text").alias("set"))


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) whose multisets have at least the weighted Jaccard similarity ``threshold``; a stored table."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_overlap(x, y) >= threshold for x, y in zip(left, right, strict=True)])

    # A node with many links is dealt in as many copies as keep the links of a copy below a bound.
    links = pairs.groupBy("b").agg((1 + F.floor(F.count(F.lit(1)) / PAIRS_A_COPY)).cast("int").alias("copies"))
    dealt = salted_join(pairs, links, "b", F.col("a")).withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    right = sets.withColumnsRenamed({"node": "b", "set": "right"}).join(links, "b")
    right = right.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    left = dealt.drop("copies").join(sets.withColumnsRenamed({"node": "a", "set": "left"}), "a")
    return written(left.join(right, ["b", "copy"]).filter(alike("left", "right")).select("a", "b"), "links")


def _blocks(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (block, node, root, query, set) of the comparisons left in the buckets of ``members``.

    Queries are the nodes outside a bucket's largest component. They are dealt by hash into parts, the bucket's nodes into
    parts of their own, and every pair of parts is a block of about QUERY_BYTES and BLOCK_BYTES.
    """
    sized = sets.select("node", F.octet_length("set").cast("long").alias("bytes"))
    rows = written(_named(members.select("bucket", "node"), labels).join(sized, "node"), "open")
    by_root = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    total = by_root.groupBy("bucket").agg(F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    left = F.greatest((F.col("bytes") - F.col("top.bytes")) / QUERY_BYTES, (F.col("n") - F.col("top.n")) / QUERIES)
    parts = total.select(
        "bucket", F.col("top.root").alias("largest"), F.ceil(left).cast("int").alias("qs"), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("ms")
    )
    rows = salted_join(rows, parts, "bucket", F.col("node")).withColumn("query", F.col("root") != F.col("largest"))
    part = lambda n, seed: F.pmod(F.xxhash64("node", "bucket", F.lit(seed)), F.col(n)).cast("int")
    q, m = F.sequence(F.lit(0), F.col("qs") - 1), F.sequence(F.lit(0), F.col("ms") - 1)
    as_member = F.transform(q, lambda i: F.struct(i.alias("q"), part("ms", 1).alias("m"), F.lit(False).alias("query")))
    as_query = F.transform(m, lambda i: F.struct(part("qs", 2).alias("q"), i.alias("m"), F.lit(True).alias("query")))
    places = F.concat(as_member, F.when(F.col("query"), as_query).otherwise(F.array().cast("array<struct<q:int,m:int,query:boolean>>")))
    dealt = rows.select("bucket", "node", "root", F.explode(places).alias("at")).join(sets, "node")
    return dealt.select(F.struct("bucket", "at.q", "at.m").alias("block"), "node", "root", F.col("at.query").alias("query"), "set")


def _block_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the queries of each block and its nodes of other components; a stored table."""
    kind = blocks.schema["node"].dataType.simpleString()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        roots = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in frame["root"]]
        group = pd.factorize(pd.Series(roots))[0]
        query = frame["query"].to_numpy()
        asked, given = np.flatnonzero(query), np.flatnonzero(~query)
        found: list[tuple] = []
        if len(asked) and len(given):
            sets = [np.frombuffer(s, np.uint64) for s in frame["set"]]
            known = np.unique(np.concatenate([sets[k] for k in asked]))
            has = np.zeros((len(asked), len(known) + 1), bool)
            for i, k in enumerate(asked):
                has[i, np.searchsorted(known, sets[k])] = True
            sizes = np.array([len(s) for s in sets])
            # Few members at a time, so that the table of queries by their elements stays small.
            step = np.cumsum(sizes[given]) // STEP_ELEMENTS
            for some in np.split(given, np.flatnonzero(np.diff(step)) + 1):
                flat = np.concatenate([sets[k] for k in some])
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                at = np.where(known[at] == flat, at, len(known))
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                both = np.add.reduceat(has[:, at].view(np.uint8), starts, axis=1, dtype=np.int32)
                near = both >= threshold * (sizes[asked][:, None] + sizes[some][None, :] - both)
                for i, j in zip(*np.nonzero(near & (group[asked][:, None] != group[some][None, :])), strict=True):
                    found.append((frame["node"].iat[asked[i]], frame["node"].iat[some[j]]))
        return pd.DataFrame(found, columns=["a", "b"])

    return written(blocks.groupBy("block").applyInPandas(compare, f"a {kind}, b {kind}").distinct(), "links")


def _elements(text: str) -> bytes:
    """Sorted hashes of the multiset's elements: the n-th copy of a shingle is an element of its own."""
    hashes = np.sort(shingles(words_of_text(text)))
    if not len(hashes):
        return b""
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    nth = np.arange(len(hashes)) - np.repeat(first, np.diff(np.concatenate([first, [len(hashes)]])))
    return np.sort(_mixed(hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).tobytes()


def _overlap(left: bytes, right: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    if min(len(a), len(b)) < 1:
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(k, tie, root): one row per row of ``docs``; root is the least document (k, g) of its class of near duplicates."""
    rows = written(sketched(docs, key, text), "sketches")
    nodes = rows.groupBy("g", "g2").agg(F.min(F.struct("k", "g", "tie")).alias("least"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("g", "g2", F.struct("least.k", "g").alias("node"), F.col("least.tie").alias("tie"), "bands"), "nodes")
    k, tie = _identity(key, text)
    source = docs.select(k.alias("k"), tie.alias("tie"), text_of(text).alias("text"))
    at = nodes.select(F.col("node.k").alias("k"), "tie", "node")

    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(salted_join(members, shared, "bucket", F.col("node")), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    members = written(members.join(central, "node").select("bucket", "node", "central"), "members")
    wanted = at.join(members.select("node").distinct(), "node", "left_semi")
    texts = source.join(wanted, ["k", "tie"]).dropDuplicates(["node"]).select("node", "text")
    sets = written(_multisets(texts), "multisets")

    links, tried, labels = None, None, None
    for _ in range(STARS):
        heads = members.groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("head")).select("bucket", F.col("head.node").alias("head"))
        members = written(salted_join(members, heads, "bucket", F.col("node")), "members")
        pairs = members.filter("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        links, tried, labels = _linked(pairs, sets, links, tried, labels, threshold)
        members = _unresolved(members.filter("node <> head").drop("head"), "bucket", labels)
        if members.isEmpty():
            break
        sets = written(sets.join(members.select("node").distinct(), "node", "left_semi"), "multisets")

    if not members.isEmpty():
        links = links.unionByName(_block_links(_blocks(members, sets, labels), threshold))
        labels = components(links)
    group = nodes.join(labels, "node", "left").select(F.struct("g", "g2").alias("words"), F.coalesce("root", "node").alias("root"))
    own = rows.select("k", "tie", F.struct("g", "g2").alias("words"))
    return salted_join(own, group, "words", F.struct("k", "tie")).select("k", "tie", "words", "root")


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unresolved(members: DataFrame, place: str, labels: DataFrame) -> DataFrame:
    """Members of places (buckets, elements) that hold nodes of more than one component; a stored table."""
    open_ = _named(members, labels).groupBy(place).agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    open_ = open_.filter("r0 <> r1").select(place)
    return written(salted_join(members, open_, place, F.col("node")).select(*members.columns), "unresolved")


def _linked(pairs: DataFrame, sets: DataFrame, links, tried, labels, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare the pairs that are neither tried nor joined yet: all links, pairs tried, and components so far."""
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        ends = [labels.withColumnsRenamed({"node": x, "root": f"root_{x}"}) for x in ("a", "b")]
        pairs = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
        pairs = pairs.filter("NOT (root_a <=> root_b) OR root_a IS NULL").select("a", "b")
    pairs = written(pairs, "pairs")
    found = _compared(pairs, sets, threshold)
    links = found if links is None else links.unionByName(found)
    return links, pairs if tried is None else tried.unionByName(pairs), components(links)


def _key(column: Column) -> Column:
    return F.when(column != NO_KEY, column)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the least by key, then by hash of its words and text."""
    found = classes(docs, key, text, threshold)
    names = ["near_dedup_key", "near_dedup_tie"]
    least = found.groupBy("root").agg(F.min(F.struct("k", "tie")).alias("first"))
    least = least.select(F.col("first.k").alias(names[0]), F.col("first.tie").alias(names[1]))
    rows = docs.withColumns(dict(zip(names, _identity(key, text), strict=True))).join(least, names, "left_semi")
    return rows.dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op9: the class of near duplicates of every document, named by its least doc_id."""
    from plumbline.llm.common import table

    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(_key(F.col("k")).alias("doc_id"), _key(F.col("root.k")).alias("class_id"))
