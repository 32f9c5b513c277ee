"""Compression of vectors to short codes: a codebook per part of the vector, assigned through memoised grid cells.

Components become the integers floor(SCALE * x), so that all distances and sums are exact and no order of summation
matters. Vectors are cut into equal consecutive parts; every part position has a codebook, which starts as that part of the
first vectors by id and is refined in rounds: each part goes to its nearest entry, then each entry becomes the
componentwise floor of the mean of its parts.

Assignment goes through a grid. The cell of a part is the box of the intervals that its components lie in. Over the
whole box an entry has a least and a greatest distance; an entry whose least distance is above the smallest greatest distance
of all entries can be nearest to no point of the box. What is left is remembered under the cell, and only those entries are
measured exactly, for each part of the cell. The bounds of a box are sums over its components, so they are added up from
tables by pairs of components. A wider cell is met more often and keeps more entries.

Only sums per entry leave the tasks of a round: entries x components numbers a task, whatever the number of rows. The
codebooks (parts x entries x components of a part) are all that the driver holds.

Defined cases: null vectors, and vectors with null, NaN or infinite components, are dropped; a shorter vector is followed by
zeros, and so is one whose length is no multiple of the parts; integers beyond +-LARGEST are held at that bound; with fewer
rows than entries a codebook has one entry per row; repeated rows are coded each; rows with a null id start a codebook last;
null labels count as one label; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.components import salted_join

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
WIDTH = 0.35  # of a cell, in standard deviations of the entries' components
GRID = 24  # intervals of a component
SLACK = 1e-5
LARGEST = 1 << 24
MOST_CELLS = 20_000  # cells that a worker remembers for each part
STEP_CELLS = 256
STEP_PAIRS = 1 << 15
_INFINITY = float("inf")


def usable(vector: Column) -> Column:
    """Is the vector there, with finite components only?"""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < _INFINITY), F.lit(False))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column (no nulls), followed by zeros up to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
    return out


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


class CellMemo:
    """Nearest entries of one codebook, through the entries remembered for each cell.

    A component has GRID intervals around the mean of the entries, each ``width`` standard deviations wide; the outermost ones
    are open. Bounds are single-precision numbers, compared with a slack that is above their rounding error.
    """

    def __init__(self, entries: np.ndarray, width: float = WIDTH):
        self.entries = entries
        n, dims = entries.shape
        self.known: dict[bytes, np.ndarray] = {}
        self.counts = {"parts": 0, "cells": 0, "measured": 0}
        self.step = max(1, int(entries.std() * width)) if entries.size else 1
        self.low = (entries.mean(axis=0) if n else np.zeros(dims)).astype(np.int64) - self.step * (GRID // 2)
        # Least and greatest squared distance of every entry from every interval of a component, then of a pair of components.
        edge = self.low + self.step * np.arange(GRID)[:, None]  # interval, component
        low, high = edge.copy(), edge + self.step - 1
        low[0], high[-1] = -LARGEST, LARGEST
        values, low, high = entries[None], low[:, None, :], high[:, None, :]
        least = np.maximum(0, np.maximum(low - values, values - high)) ** 2
        greatest = np.maximum(np.abs(low - values), np.abs(high - values)) ** 2
        single = np.concatenate([least, greatest], axis=1).astype(np.float32)  # interval, entry twice, component
        if dims % 2:
            single = np.concatenate([single, np.zeros((GRID, 2 * n, 1), np.float32)], axis=2)
        self.pairs = [(single[:, None, :, k] + single[None, :, :, k + 1]).reshape(GRID * GRID, 2 * n) for k in range(0, dims, 2)]

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For every box, the entries that no other entry dominates, ascending."""
        out, n = [], len(self.entries)
        if cells.shape[1] % 2:
            cells = np.concatenate([cells, np.zeros((len(cells), 1), cells.dtype)], axis=1)
        row_of = cells[:, ::2].astype(np.int64) * GRID + cells[:, 1::2]
        for start in range(0, len(cells), STEP_CELLS):
            some = row_of[start : start + STEP_CELLS]
            bounds = self.pairs[0][some[:, 0]]
            for k in range(1, len(self.pairs)):
                bounds += self.pairs[k][some[:, k]]
            keep = bounds[:, :n] <= bounds[:, n:].min(axis=1, keepdims=True) * np.float32(1 + SLACK)
            row, entry = np.nonzero(keep)
            entry, ends = entry.astype(np.int32), np.searchsorted(row, np.arange(len(some)), "right").tolist()
            out += [entry[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every part, the lower one on a tie, and its squared distance."""
        index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if not len(parts) or not parts.shape[1]:
            return index, error
        cells = np.clip((parts - self.low) // self.step, 0, GRID - 1).astype(np.int8)
        names = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.shape[1]))).reshape(-1).tolist()
        if len(self.known) > MOST_CELLS:
            self.known = {k: self.known[k] for k in set(names) & self.known.keys()}
        new = list(dict.fromkeys(k for k in names if k not in self.known))
        if new:
            self.known.update(zip(new, self.candidates(np.frombuffer(b"".join(new), np.int8).reshape(len(new), -1)), strict=True))
        left = [self.known[k] for k in names]
        sizes = np.fromiter(map(len, left), np.int64, len(left))
        self.counts["parts"] += len(parts)
        self.counts["cells"] += len(new)
        self.counts["measured"] += int(sizes.sum())
        # In steps of about STEP_PAIRS exact distances.
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // STEP_PAIRS)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            entry = np.concatenate(left[a:b])
            difference = np.repeat(parts[a:b], sizes[a:b], axis=0) - self.entries[entry]
            distance = np.einsum("ij,ij->i", difference, difference)
            starts = ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])
            error[a:b] = np.minimum.reduceat(distance, starts)
            # Entries ascend within a part, so the first that is at the least distance is the lowest.
            best = np.flatnonzero(distance == np.repeat(error[a:b], sizes[a:b]))
            index[a:b] = entry[best[np.searchsorted(best, starts)]]
        return index, error


def _kept(rows: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    columns = [F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")]
    if label:
        columns.append(F.col(f"`{label}`").alias("label"))
    return rows.filter(usable(F.col(f"`{vector}`"))).select(*columns)


def start_books(rows: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks to begin with: that part of the ``entries`` vectors with the smallest ids."""
    kept = _kept(rows, key, vector)
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    size = -(-longest // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").head(entries)
    whole = np.zeros((len(first), size * parts))
    for k, row in enumerate(first):
        whole[k, : len(row["vec"])] = row["vec"]
    return [integers(whole[:, p * size : (p + 1) * size], scale) for p in range(parts)]


def _sums(kept: DataFrame, books: list[np.ndarray], scale: int, width: float) -> DataFrame:
    """(part, entry, place, total, n): sums of the parts that go to each entry, one partial row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(b, width) for b in books]
        size = books[0].shape[1]
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            whole = integers(matrix(batch.column(0), size * len(books)), scale)
            for p, memo in enumerate(memos):
                part = whole[:, p * size : (p + 1) * size]
                index, _ = memo.nearest(part)
                np.add.at(totals[p], index, part)
                counts[p] += np.bincount(index, minlength=len(books[p]))
        for p, total in enumerate(totals):
            entry = np.flatnonzero(counts[p])
            columns = [
                np.full(len(entry) * size, p, np.int32),
                np.repeat(entry, size).astype(np.int32),
                np.tile(np.arange(size), len(entry)).astype(np.int32),
                total[entry].reshape(-1),
                np.repeat(counts[p][entry], size),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total", "n"])

    rows = kept.select("vec").mapInArrow(run, "part int, entry int, place int, total long, n long")
    return rows.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    width: float = WIDTH,
) -> list[np.ndarray]:
    """Codebook of every part position after ``rounds`` over all rows; an entry that no part chose stays."""
    books = start_books(rows, key, vector, parts, entries, scale)
    if not len(books[0]) or not books[0].shape[1]:
        return books
    kept = _kept(rows, key, vector)
    for _ in range(rounds):
        found = _sums(kept, books, scale, width).head(sum(b.size for b in books))  # a row per component, whatever the rows
        books = [b.copy() for b in books]
        for r in found:
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, in decimals, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(
    rows: DataFrame,
    books: list[np.ndarray],
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    width: float = WIDTH,
) -> DataFrame:
    """(vec_id, label, code, error) of every usable row: entries in hexadecimal, and the squared distance of all parts."""
    kept = _kept(rows, key, vector, label)
    digits = max(2, len(f"{max(1, len(books[0])) - 1:x}"))
    kinds = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos, size = [CellMemo(b, width) for b in books], books[0].shape[1]
        for batch in batches:
            whole = integers(matrix(batch.column(1), size * len(books)), scale)
            found = [memo.nearest(whole[:, p * size : (p + 1) * size]) for p, memo in enumerate(memos)]
            codes = ["".join(f"{x:0{digits}x}" for x in c) for c in zip(*(index.tolist() for index, _ in found), strict=True)]
            error = sum(e for _, e in found)
            columns = [batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vec``: the middle of the grid step of every coded component."""
    cells = [[[(int(x) + 0.5) / scale for x in entry] for entry in book] for book in books]
    digits = max(2, len(f"{max(1, len(books[0])) - 1:x}"))

    @F.pandas_udf("array<double>")
    def whole(codes):
        cut = lambda c: [int(c[p * digits : (p + 1) * digits], 16) for p in range(len(cells))]
        return codes.map(lambda c: [x for p, entry in enumerate(cut(c)) for x in cells[p][entry]])

    return coded.withColumn("vec", whole("code"))


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op11: all embeddings coded; errors summed over equal labels."""
    from plumbline.llm.common import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(rows)
    coded = written(encode(rows, books), "codes").withColumn("same", F.to_json(F.struct("label")))
    totals = coded.groupBy("same").agg(F.sum("error").alias("label_error"))
    rows = salted_join(coded, totals, "same", F.struct("vec_id", "code"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
