"""Nearest neighbours by inner product: vantage-point trees per shard, with relaxed pruning by the triangle inequality.

With one more component, sqrt(longest^2 - |x|^2) for a stored vector and 0 for a query, the largest inner product is the
smallest Euclidean distance, which is a metric: d^2 = |q|^2 + longest^2 - 2 q.x. A tree node holds a vantage point and, for
each half of its vectors, the least and greatest distance from it. A query can be no closer to a half than the gap between
its own distance and that range. The half is skipped if ``factor`` times the gap is above the distance of the best so far:
with factor 1 only what cannot matter is skipped and the search is exact; a larger factor skips more and may miss some.

The upper levels of the tree are fitted on a bounded sample (SAMPLE rows, the least by hash) and cut space into regions; a
region with more rows than a shard holds is dealt to several shards by hash, so that a group of copies does not make a
large one. Every row is indexed. A query starts with the distances to the sample, is sent to the shards whose regions it may
not skip, and searches their trees; blocks of queries stream past a shard's tree, and the best of all shards are merged.
Rows per shard grow with the square root of the table, so that queries x shards stays far below queries x rows.

Scores are sums of products in the order of the components, in double precision, so equal vectors score equally wherever they are.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a shorter vector is followed
by zeros; rows that agree in id and vector are one; of rows with one id and other vectors each is a query of its own, and none
is a candidate of the other; rows with a null id are no queries and no candidates; equal scores go by the smaller id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.vector_codes import matrix, usable

NEAREST = 20
EVERY = 20
FACTOR = 4.0
SAMPLE = 4096
LEAF = 192
ROWS_A_ROOT = 32  # rows of a shard, for every unit of the square root of the table's rows
QUERY_BLOCK = 1 << 18
STEP_QUERIES = 2048
MOST_HITS = 1 << 20
_SLACK = 1e-9
_FOUND = "query_id long, tie long, vec_id long, score double"


@dataclass(eq=False)
class Node:
    """Inner node: vantage point (a row number) and, per half, its range of distances and its node; or a leaf's rows and number."""

    vantage: int = -1
    ranges: tuple = ()
    halves: tuple = ()
    rows: np.ndarray | None = None
    number: int = -1


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, added up in the order of the components."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += left[:, k] * right[:, k]
    return total


def distances(inner: np.ndarray, squares: np.ndarray | float, more: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, squares + more - 2 * inner))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that gives all of them the square length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest - (vectors**2).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def tree(points: np.ndarray, longest: float, leaf: int) -> Node:
    """Vantage-point tree of lifted vectors. Of a few rows, the vantage is the one whose distances to some others differ most."""

    numbers = count()

    def build(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows, number=next(numbers))
        some, few = rows[:: max(1, len(rows) // 64)], rows[:: max(1, len(rows) // 8)]
        spread = distances(points[few] @ points[some].T, longest, longest).std(axis=1)
        vantage = int(few[spread.argmax()])
        away = distances(points[rows] @ points[vantage], longest, longest)
        order = np.argpartition(away, len(rows) // 2)
        ranges, halves = [], []
        for part in (order[: len(rows) // 2], order[len(rows) // 2 :]):
            ranges.append((float(away[part].min()), float(away[part].max())))
            halves.append(build(rows[part]))
        return Node(vantage, tuple(ranges), tuple(halves))

    return build(np.arange(len(points)))


class Best:
    """The ``count`` best candidates of every query so far, and the score that a further one must reach."""

    def __init__(self, queries: int, count: int):
        self.count = count
        self.floor = np.full(queries, -np.inf)
        self.held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.new.append((query, row, score))
        self.waiting += len(query)
        if self.waiting > MOST_HITS:
            self.settle()

    def settle(self) -> None:
        """Keep what may be among the best: up to a rounding error below the last of them."""
        query, row, score = (np.concatenate([h, *n]) for h, n in zip(self.held, zip(*self.new, strict=True) if self.new else [()] * 3, strict=True))
        self.new, self.waiting = [], 0
        order = np.lexsort((-score, query))
        query, row, score = query[order], row[order], score[order]
        starts = np.searchsorted(query, np.arange(len(self.floor)))
        last = starts + self.count - 1
        full = np.flatnonzero((last < len(query)) & (query[np.minimum(last, max(0, len(query) - 1))] == np.arange(len(self.floor)) if len(query) else False))
        self.floor[full] = np.maximum(self.floor[full], score[last[full]] - _SLACK * np.maximum(1, np.abs(score[last[full]])))
        keep = score >= self.floor[query]
        self.held = [query[keep], row[keep], score[keep]]


class Shard:
    """The vectors of a shard, equal ones once, and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, nearest: int, leaf: int = LEAF):
        self.longest, self.nearest = longest, nearest
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        # Of equal vectors no more than the least ids, and one that may be the query's own, can be among the nearest.
        order = np.lexsort((ids, inverse.reshape(-1)))
        first = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(self.vectors) + 1))
        self.ids = [ids[order[a : min(b, a + nearest + 1)]] for a, b in zip(first, first[1:], strict=False)]
        self.points = lifted(self.vectors, longest)
        self.tree = tree(self.points, longest, leaf) if len(self.vectors) else None

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, score) of the nearest of every query that score at least ``floor``."""
        # A query's own vector may take one place.
        best = Best(len(queries), self.nearest + 1)
        best.floor = floor - _SLACK * np.maximum(1, np.abs(floor))
        squares = (queries**2).sum(axis=1)
        if self.tree is not None:
            home = self._measure_home(queries, squares, best)
            best.settle()
            self._visit(self.tree, np.arange(len(queries)), queries, squares, best, factor, home)
        best.settle()
        query, row, _ = best.held
        sizes = np.fromiter((len(self.ids[r]) for r in row.tolist()), np.int64, len(row))
        found = np.concatenate([self.ids[r] for r in row.tolist()]) if len(row) else np.empty(0, np.int64)
        score = np.repeat(products(queries[query], self.vectors[row]), sizes)
        query = np.repeat(query, sizes)
        other = found != ids[query]
        query, found, score = query[other], found[other], score[other]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return query[place < self.nearest], found[place < self.nearest], score[place < self.nearest]

    def _gaps(self, node: Node, queries: np.ndarray, squares: np.ndarray) -> list[np.ndarray]:
        """For each half, the least distance that the triangle inequality leaves to the queries."""
        away = distances(queries @ self.vectors[node.vantage], squares, self.longest)
        return [np.maximum(low - away, away - high) for low, high in node.ranges]

    def _measure_home(self, queries: np.ndarray, squares: np.ndarray, best: Best) -> np.ndarray:
        """Measure and name the leaf that each query comes to by always taking the half of the smaller gap."""
        home = np.zeros(len(queries), np.int64)
        todo = [(self.tree, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            if node.rows is not None:
                home[asked] = node.number
                self._measure(node, asked, queries, best)
                continue
            left, right = self._gaps(node, queries[asked], squares[asked])
            todo += [(half, asked[at]) for half, at in zip(node.halves, (left <= right, left > right), strict=True) if at.any()]
        return home

    def _measure(self, leaf: Node, asked: np.ndarray, queries: np.ndarray, best: Best) -> None:
        scores = queries[asked] @ self.vectors[leaf.rows].T
        q, r = np.nonzero(scores >= best.floor[asked][:, None])
        best.add(asked[q], leaf.rows[r], scores[q, r])

    def _visit(self, node: Node, asked: np.ndarray, queries, squares, best: Best, factor: float, home: np.ndarray) -> None:
        if node.rows is not None:
            self._measure(node, asked[home[asked] != node.number], queries, best)
            return
        gaps = self._gaps(node, queries[asked], squares[asked])
        for gap, half in zip(gaps, node.halves, strict=True):
            reach = distances(best.floor[asked], squares[asked], self.longest)
            near = factor * gap <= reach * (1 + _SLACK) + _SLACK
            if near.any():
                self._visit(half, asked[near], queries, squares, best, factor, home)


class Regions:
    """The upper levels of the tree, fitted on the sample; a region is a path of halves."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, longest: float, regions: int, nearest: int):
        self.ids, self.sample, self.longest, self.nearest = ids, sample, longest, nearest
        self.points = lifted(sample, longest)
        size = -(-len(sample) // max(1, regions)) if len(sample) else 1
        self.tree = tree(self.points, longest, max(1, size))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The region of every vector: at each node, the inner half up to the border between both ranges."""
        out = np.zeros(len(vectors), np.int32)
        points = lifted(vectors, self.longest)
        todo = [(self.tree, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node.rows is not None:
                out[rows] = node.number
                continue
            inner = distances(points[rows] @ self.points[node.vantage], self.longest, self.longest) <= self.border(node)
            todo += [(node.halves[0], rows[inner]), (node.halves[1], rows[~inner])]
        return out

    @staticmethod
    def border(node: Node) -> float:
        return (node.ranges[0][1] + node.ranges[1][0]) / 2

    def route(self, ids: np.ndarray, queries: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, region) pairs that may hold neighbours, and the score that the sample already reaches."""
        squares = (queries**2).sum(axis=1)
        scores = queries @ self.sample.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        floor = np.full(len(queries), -np.inf)
        if len(self.ids) >= self.nearest:
            floor = np.partition(scores, -self.nearest, axis=1)[:, -self.nearest]
        reach = distances(floor, squares, self.longest)
        pairs: list[tuple[np.ndarray, int]] = []
        todo = [(self.tree, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            if node.rows is not None:
                pairs.append((asked, node.number))
                continue
            away = distances(queries[asked] @ self.sample[node.vantage], squares[asked], self.longest)
            border = self.border(node)
            for half, gap in zip(node.halves, (away - border, border - away), strict=True):
                near = factor * gap <= reach[asked] * (1 + _SLACK) + _SLACK
                if near.any():
                    todo.append((half, asked[near]))
        query = np.concatenate([a for a, _ in pairs])
        return query, np.repeat(np.array([r for _, r in pairs], np.int32), [len(a) for a, _ in pairs]), floor


def _rows(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    kept = embeddings.filter(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`")) & F.exists(v, lambda x: x != 0))
    kept = kept.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("vec"))
    return kept.withColumn("tie", F.xxhash64("vec")).dropDuplicates(["vec_id", "tie"])


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def search(
    embeddings: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    every: int = EVERY,
    factor: float = FACTOR,
    sample: int = SAMPLE,
    rows_a_root: int = ROWS_A_ROOT,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row whose id is divisible by ``every``."""
    rows = written(_rows(embeddings, key, vector), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, dims, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(square)).first()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest *= 1 + 1e-12  # no vector is longer by rounding
    few = rows.orderBy(F.xxhash64("vec_id", "tie"), "vec_id", "tie").head(sample)
    ids, fitted = np.array([r["vec_id"] for r in few]), np.zeros((len(few), dims))
    for k, r in enumerate(few):
        fitted[k, : len(r["vec"])] = r["vec"]
    shard_rows = max(1, int(rows_a_root * n**0.5))
    regions = spark.sparkContext.broadcast(Regions(ids, fitted, longest, min(-(-n // shard_rows), max(1, len(few) // 16)), nearest))
    blocks = -(-n // (every * QUERY_BLOCK))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = regions.value.of(matrix(_column(batch, "vec"), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP_QUERIES):
                part = batch.slice(a, STEP_QUERIES)
                query, region, floor = regions.value.route(_column(part, "vec_id").to_numpy(), matrix(_column(part, "vec"), dims), factor)
                taken = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(region), pa.array(floor[query])], names=[*part.schema.names, "region", "floor"])

    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    placed_rows = written(rows.mapInArrow(placed, f"{kind}, region int"), "placed")
    salts = placed_rows.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).cast("int").alias("salts"))
    queries = rows.filter(F.col("vec_id") % every == 0).mapInArrow(routed, f"{kind}, region int, floor double")
    # One row per region; a region's stored rows go to one salt each, its queries to all.
    hashed = F.pmod(F.xxhash64("tie", "vec_id"), F.col("salts")).cast("int")
    stored = placed_rows.join(F.broadcast(salts), "region").withColumn("salt", hashed).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.join(F.broadcast(salts), "region").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "tie", F.lit(1)), F.lit(blocks)).cast("int"))
    place = ["region", "salt", "block"]
    both = stored.select(*place, F.lit(None).cast("double").alias("floor"), "vec_id", "tie", "vec").unionByName(
        asked.select(*place, F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "vec_id", "tie", "vec")
    )
    dealt = both.repartition(*place).sortWithinPartitions(*place, F.col("floor").isNotNull())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            names = np.stack([_column(batch, c).to_numpy() for c in place] + [np.asarray(_column(batch, "floor").is_valid())], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *name, is_query = names[a].tolist()
                part = batch.slice(a, b - a)
                if name != at:
                    at, held, shard = name, [], None
                ids, vectors = _column(part, "vec_id").to_numpy(), matrix(_column(part, "vec"), dims)
                if not is_query:
                    held.append((ids, vectors))
                    continue
                if shard is None and held:
                    shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), longest, nearest)
                    held = []
                for s in range(0, len(ids) if shard else 0, STEP_QUERIES):
                    step = slice(s, s + STEP_QUERIES)
                    query, found, score = shard.search(ids[step], vectors[step], _column(part, "floor").to_numpy()[step], factor)
                    mine = part.slice(s, STEP_QUERIES).take(pa.array(query))
                    yield pa.RecordBatch.from_arrays(
                        [_column(mine, "vec_id"), _column(mine, "tie"), pa.array(found), pa.array(score)], names=["query_id", "tie", "vec_id", "score"]
                    )

    found = dealt.mapInArrow(searched, _FOUND)
    order = Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), "vec_id")
    # A candidate id with several vectors counts by its best one.
    found = found.groupBy("query_id", "tie", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op12: the 20 nearest found of every embedding whose vec_id is divisible by 20."""
    from plumbline.llm.common import table

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
