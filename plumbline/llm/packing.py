"""Packing token pieces into sequences by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits into a sequence. The program asks for the least number of sequences
whose configurations cover the histogram. Multiplicative weights solve it: every length has a price that falls as it
gets covered, a knapsack dynamic program finds the configurations of the highest price, and their average is the
solution. It is rounded down to whole sequences; what is left is placed best-fit, longest first, into gaps of the rounded
sequences and then into new ones. All this sees only the histogram (at most ``capacity`` numbers), so its cost does not
depend on the data. Pieces get their place by number: the k-th piece of a length takes the k-th slot of that length.
Numbers are given per (length, bucket), so that a length that most pieces share is split over many tasks.

Defined cases: a null or empty text is one piece with the end token alone; repeated rows are packed each; an empty table
gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import MOST_WORDS, VOCABULARY, coder, slices
from plumbline.llm.common import written

CAPACITY = 2048
END = 0
ROUNDS = 400
COLUMNS_A_ROUND = 48
STEP = 0.05  # most that the coverage of a length grows by one configuration of a round
SOFTNESS = 0.2  # coverage by which a price falls to 1/e
LENGTH_POWER = 1.1  # long pieces have fewer partners, so they are priced a little above their room
BUCKET_ROWS = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False, most_words: int = MOST_WORDS
) -> DataFrame:
    """Pieces of all documents: the ids of the text, then END; longer ones in full pieces after a first, shorter one.

    ``most_words`` bounds what a worker remembers; it changes the time, not the result.
    """
    schema = _PIECE + (", ids binary" if with_ids else "")
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(batch, texts):
                rows = []
                for key, ids in zip(keys[a:b], coder(vocabulary, most_words).encode(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        part = ids[4 * s : 4 * e]
                        rows.append((key, k, s, e - s, zlib.crc32(part), part))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*rows, strict=True))[: 6 if with_ids else 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _priced(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the highest price that fits into each size, and the length to take first (0: none).

    ``prices[l]`` is that of length l; a length may be taken any number of times.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    # Position p of the reversed prices holds length capacity - p, so that sizes and lengths run in step.
    reverse = prices[::-1]
    for size in range(1, capacity + 1):
        value = best[:size] + reverse[capacity - size : capacity]
        at = int(value.argmax())
        if value[at] > best[size - 1]:
            best[size], take[size] = value[at], size - at
        else:
            best[size] = best[size - 1]
    return best, take


def _filled(take: np.ndarray, best: np.ndarray, size: int) -> list[int]:
    """Lengths of the best filling of ``size``."""
    found = []
    while size > 0 and best[size] > 0:
        if take[size]:
            found.append(int(take[size]))
            size -= int(take[size])
        else:
            size -= 1
    return found


def configurations(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Approximate solution of the program: sequences per configuration, as fractions of whole ones.

    Every round prices the lengths by their coverage so far, and takes the best configuration around each of the least
    covered ones, so often that no coverage grows by more than STEP. A covered length has no price any more.
    """
    lengths = np.flatnonzero(counts)
    solution: Counter = Counter()
    covered, share, prices = np.zeros(capacity + 1), np.zeros(capacity + 1), np.zeros(capacity + 1)
    for _ in range(rounds if len(lengths) else 0):
        share[lengths] = covered[lengths] / counts[lengths]
        low = share[lengths].min()
        if low >= 1 - 1e-9:
            break
        prices[lengths] = lengths**LENGTH_POWER * np.exp(-(share[lengths] - low) / SOFTNESS)
        prices[lengths[share[lengths] >= 1]] = 0
        best, take = _priced(prices, capacity)
        taken = 0
        for first in lengths[np.argsort(share[lengths], kind="stable")].tolist():
            if covered[first] >= counts[first] * min(1, low + STEP):
                continue
            config = Counter([first, *_filled(take, best, capacity - first)])
            times = min(min(counts[x] * STEP, counts[x] - covered[x]) / n for x, n in config.items())
            if times > 1e-9 * counts[first]:
                solution[tuple(sorted(config.elements(), reverse=True))] += times
                for x, n in config.items():
                    covered[x] += n * times
                taken += 1
            if taken == COLUMNS_A_ROUND:
                break
    return solution


def packed(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole sequences: (lengths of a sequence, how many such) that hold exactly the histogram ``counts[length]``."""
    left = counts.astype(np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = []
    solution = configurations(left, capacity)
    # Fullest first: they waste nothing, whatever the rest does.
    for config, times in sorted(solution.items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
        need = Counter(config)
        n = int(min(np.floor(times + 1e-6), min(left[x] // k for x, k in need.items())))
        if n > 0:
            groups.append((config, n))
            for x, k in need.items():
                left[x] -= k * n
    return _best_fit(left, capacity, groups)


def _best_fit(left: np.ndarray, capacity: int, groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Place what is left, longest first, into the smallest gap that takes it; equal sequences are handled together."""
    by_gap: dict[int, list[list]] = {}
    open_gaps = np.zeros(capacity + 1, bool)

    def add(config: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(config)
        by_gap.setdefault(gap, []).append([config, n])
        open_gaps[gap] = True

    for config, n in groups:
        add(config, n)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                config, have = by_gap[gap].pop()
                open_gaps[gap] = bool(by_gap[gap])
                used = min(n, have)
                if have > used:
                    by_gap[gap].append([config, have - used])
                    open_gaps[gap] = True
                add((*config, length), used)
                n -= used
            else:
                each = capacity // length
                if n >= each:
                    add((length,) * each, n // each)
                if n % each:
                    add((length,) * (n % each), 1)
                n = 0
    merged: Counter = Counter()
    for held in by_gap.values():
        for config, n in held:
            merged[tuple(sorted(config, reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first number of each run of slots, the sequence of that first one, and the offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for config, n in groups:
        offset = 0
        for length in config:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (read twice; a stored table) with sequence_id and offset."""
    total, hist = 0, np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).head(capacity):  # one row per length
        hist[row["length"]] = row["n"]
        total += row["n"]
    places = slots(packed(hist, capacity))
    buckets = 1 + total // BUCKET_ROWS
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per_bucket = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("k", F.row_number().over(order) - 1).join(first, ["length", "bucket"])
    rows = rows.withColumn("k", F.col("k") + F.col("first")).select(*pieces.columns, "k")
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, at in frame.groupby("length").indices.items():
                starts, sequences, offsets = places[int(length)]
                k = frame["k"].to_numpy()[at]
                run = np.searchsorted(starts, k, "right") - 1
                sequence[at], offset[at] = sequences[run] + k - starts[run], offsets[run]
            yield frame.assign(sequence_id=sequence, offset=offset)[names]

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return rows.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The ids of every sequence, for pieces that were cut ``with_ids``; a sequence has at most ``capacity`` of them."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed_pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op6: all documents packed into sequences of CAPACITY tokens."""
    from plumbline.llm.common import table

    return pack(written(cut(table(spark, sf_dir, "documents")), "pieces"))
