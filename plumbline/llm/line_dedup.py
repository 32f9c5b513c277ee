"""Line deduplication by a suffix array over line ids.

A document is the sequence of its lines with a word. A suffix starts at any of these lines. Prefix doubling ranks the
suffixes by their first 1, 2, 4, ... lines: the rank of twice as many lines is the rank of the first half plus the number
of suffixes with the same first half and a lower second half. A suffix whose class has no second member cannot start a
repeated run; it has no rank and leaves the doubling.

All suffixes that agree in their first m lines are neighbours in this order: an interval of common prefix m, named by two
overlapping ranks of 2**k <= m lines. A run counts if it has ``min_words`` words. Of each repeated run the copy at the
least (key, line) stays and the lines of all later copies go. A maximal run is the union of its least windows of
``min_words`` words, taken forwards from each of its lines and backwards from its last one, so no depth beyond
``min_words`` lines is needed: the number of rounds depends on that alone, not on the data.

Groups are counted before each shuffle, and the tables of classes meet the suffixes salted, so a line that a third of all
documents have is spread over SALTS tasks; a class whose next lines differ widely is numbered in BUCKETS parts.

Defined cases: a null text stays null and has no lines; lines without a word are kept; a null key comes before all others;
rows that agree in key and text are one document, and each gets its result; extra columns are kept, columns with a
result's name are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, written

MIN_WORDS = 50
SALTS = 8
BUCKETS = 256
DOC = ["dedup_key", "dedup_tie"]
_RESULT = ("n_lines", "n_removed", "n_removed_words")
_LINES = "dedup_key long, dedup_tie long, pos int, h1 long, h2 long, ahead int, back int"


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    least = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    return docs.withColumns({"dedup_key": least, "dedup_tie": F.xxhash64(text_of(text))})


def _windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the least window of ``min_words`` words from each line on, and up to each line; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    ahead = np.where(end <= len(words), end - place, 0)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    back = np.where(start >= 0, place + 1 - start, 0)
    return ahead, back


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line with a word: its document, number, id (two hashes) and least windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bpe import slices

        names = [c.split()[0] for c in _LINES.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            keys, ties, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(batch, texts):
                parts: list[list[np.ndarray]] = [[] for _ in names]
                for k in range(a, b):
                    lines = [(line, n) for line in texts[k].split("\n") if (n := len(line.split()))]
                    if not lines:
                        continue
                    digest = b"".join(xxhash.xxh128_digest(line.encode()) for line, _ in lines)
                    halves = np.frombuffer(digest, "<i8").reshape(-1, 2)
                    ahead, back = _windows(np.array([n for _, n in lines]), min_words)
                    n = len(lines)
                    row = (np.full(n, keys[k]), np.full(n, ties[k]), np.arange(n), halves[:, 0], halves[:, 1], ahead, back)
                    for part, values in zip(parts, row, strict=True):
                        part.append(values)
                if parts[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(parts, kinds, strict=True)], names=names)

    rows = _identified(docs, key, text).select(*DOC, text_of(text).alias("text"))
    return rows.mapInArrow(run, _LINES).dropDuplicates([*DOC, "pos"])


def _salt() -> Column:
    return F.pmod(F.xxhash64(*DOC, "pos"), F.lit(SALTS)).cast("int")


def _joined(rows: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of their class; every class meets its rows in SALTS parts."""
    many = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", _salt()).join(many, [*on, "salt"]).drop("salt")


def _numbered(classes: DataFrame, parent: list[str], bucket: Column, order: list[str], base: Column) -> DataFrame:
    """``classes`` with ``new``: ``base`` and the members of the earlier classes of the same parent."""
    rows = classes.withColumn("bucket", bucket)
    earlier = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*parent, "bucket").agg(F.sum("n").alias("in_bucket"))
    over = Window.partitionBy(*(parent or [F.lit(0)])).orderBy("bucket").rowsBetween(*earlier)
    sums = sums.select(*parent, "bucket", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy(*parent, "bucket").orderBy(*order).rowsBetween(*earlier))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, [*parent, "bucket"])
    return rows.withColumn("new", base + F.col("before") + F.col("inside")).drop("bucket", "inside", "before", "n")


def suffix_ranks(lines: DataFrame, min_words: int = MIN_WORDS) -> list[DataFrame]:
    """Per k: (document, pos, rank) of the suffixes whose first 2**k lines stand elsewhere, too; each a stored table."""
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Hashes are spread evenly, so their leading bits deal them into buckets of like size.
    first = _numbered(repeated, [], F.shiftright("h1", 52), ["h1", "h2"], F.lit(0).cast("long"))
    ranks = _joined(lines, first, ["h1", "h2"]).select(*DOC, "pos", F.col("new").alias("rank"))
    levels = [written(ranks, "line-ranks-0")]
    width = 1 + (lines.count() // BUCKETS)
    length = 1
    while 2 * length <= min_words:
        here = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(length, length)
        pairs = levels[-1].withColumn("second", F.first("rank").over(here)).filter("second IS NOT NULL")
        classes = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        bucket = F.floor(F.col("second") / width).cast("long")
        numbered = _numbered(classes, ["rank"], bucket, ["second"], F.col("rank"))
        doubled = _joined(pairs, numbered, ["rank", "second"]).select(*DOC, "pos", F.col("new").alias("rank"))
        levels.append(written(doubled, f"line-ranks-{len(levels)}"))
        length *= 2
    return levels


def later_copies(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(document, pos, m): windows of m lines with an equal window at a lesser place."""
    windows = F.array_distinct(
        F.filter(
            F.array(
                F.struct(F.col("pos").alias("at"), F.col("ahead").alias("m")),
                F.struct((F.col("pos") + 1 - F.col("back")).alias("at"), F.col("back").alias("m")),
            ),
            lambda w: w["m"] > 0,
        )
    )
    level = F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")
    rows = lines.select(*DOC, F.explode(windows).alias("w")).select(*DOC, F.col("w.at").alias("pos"), F.col("w.m").alias("m"))
    rows = rows.withColumn("k", level).withColumn("other", (F.col("pos") + F.col("m") - F.pow(F.lit(2.0), "k")).cast("int"))
    ranks = levels[0].withColumn("k", F.lit(0))
    for k, table in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(table.withColumn("k", F.lit(k)))
    begin = ranks.withColumnRenamed("rank", "r1")
    end = ranks.withColumnsRenamed({"rank": "r2", "pos": "other"})
    rows = rows.join(begin, [*DOC, "k", "pos"]).join(end, [*DOC, "k", "other"]).select(*DOC, "pos", "m", "r1", "r2").distinct()
    place = F.struct(*DOC, "pos")
    first = rows.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return _joined(rows, first, ["m", "r1", "r2"]).filter(place > F.col("first")).select(*DOC, "pos", "m")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines of later copies; lines with a word, and how many lines and words were removed."""
    lines = written(line_table(docs, key, text, min_words), "lines")
    gone = later_copies(lines, suffix_ranks(lines, min_words))
    gone = gone.groupBy(*DOC).agg(F.collect_set(F.struct("pos", "m")).alias("dedup_gone"))
    columns = [c for c in docs.columns if c.lower() not in _RESULT]
    rows = _identified(docs.select(*[F.col(f"`{c}`") for c in columns]), key, text).join(gone, DOC, "left")

    @F.pandas_udf("text string, n_lines long, n_removed long, n_removed_words long")
    def cleaned(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_without(t, g) for t, g in zip(texts, gone, strict=True)], columns=["text", *_RESULT])

    # Marked, so that a later filter on the counts does not clean the texts twice.
    cleaned = cleaned.asNondeterministic()
    rows = rows.withColumn("dedup_cleaned", cleaned(F.col(f"`{text}`"), F.col("dedup_gone")))
    kept = [F.col("dedup_cleaned.text").alias(c) if c == text else F.col(f"`{c}`") for c in columns]
    return rows.select(*kept, *[F.col(f"dedup_cleaned.{c}") for c in _RESULT])


def _without(text: str | None, gone) -> tuple[str | None, int, int, int]:
    lines = [] if text is None else text.split("\n")
    if gone is None:
        return text, sum(1 for line in lines if line and not line.isspace()), 0, 0
    words = [len(line.split()) for line in lines]
    steps = np.zeros(len(lines) + 1, np.int64)
    for g in gone:
        steps[g["pos"]] += 1
        steps[g["pos"] + g["m"]] -= 1
    hit = np.cumsum(steps) > 0
    kept, pos, removed, removed_words = [], 0, 0, 0
    for line, n in zip(lines, words, strict=True):
        if n and hit[pos]:
            removed, removed_words = removed + 1, removed_words + n
        else:
            kept.append(line)
        pos += n > 0
    return "\n".join(kept), pos, removed, removed_words


def brute_force(rows: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> list[str | None]:
    """The same on a few documents in plain Python, for tests: all pairs of places, the longest common run of each."""
    lines = [[x for x in (t or "").split("\n") if x.split()] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], k))
    places = [(d, i) for d in order for i in range(len(lines[d]))]
    gone = set()
    for b in range(len(places)):
        for a in range(b):
            (d, i), (e, j) = places[a], places[b]
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            if sum(len(x.split()) for x in lines[e][j : j + n]) >= min_words:
                gone |= {(e, j + x) for x in range(n)}
    out: list[str | None] = []
    for d, (_, text) in enumerate(rows):
        kept, pos = [], 0
        for line in [] if text is None else text.split("\n"):
            if not line.split() or (d, pos) not in gone:
                kept.append(line)
            pos += bool(line.split())
        out.append(None if text is None else "\n".join(kept))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op3: all documents without later copies of repeated line runs."""
    from plumbline.llm.common import table

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
