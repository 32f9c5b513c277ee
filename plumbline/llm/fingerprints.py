"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every distinct 64-bit shingle hash below a fixed share of the hash range, whatever the length of the
document. So sketches of any two documents, however unequal, compare the same part of the hash range: intersections,
containments and unions are estimated without bias, and the sketch of a union is the union of the sketches. A document
none of whose hashes is low enough keeps its lowest one.

Defined cases: a null or wordless text has the empty fingerprint, which is like another empty one (1) and unlike all others
(0); a text of fewer than ``SHINGLE`` words is one shingle; equal texts have equal fingerprints; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, unused, window_hashes, words_of

SHINGLE = 5
SHARE = 4  # one hash in SHARE is kept
NO_KEY = -(1 << 63)
BUCKET_ROWS = 1_000
MOST_BUCKETS = 4096
SAMPLE_PER_BUCKET = 200


def with_sketch(docs: DataFrame, text: str, name: str, share: int = SHARE) -> DataFrame:
    """``docs`` with the sorted distinct low hashes of the lower-cased text's shingles, as an array of longs.

    The steps are columns of their own, so that none is evaluated twice.
    """
    limit = -(1 << 63) + (1 << 64) // share
    words, hashes, kept = own = unused(docs, "sketch_words", "sketch_hashes", "sketch_low")
    rows = docs.withColumn(words, words_of(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    rows = rows.withColumn(hashes, window_hashes(F.col(words), SHINGLE))
    rows = rows.withColumn(kept, F.filter(hashes, lambda h: h < F.lit(limit).cast("long")))
    low, lowest = F.sort_array(F.array_distinct(kept)), F.slice(F.sort_array(hashes), 1, 1)
    return rows.withColumn(name, F.when(F.size(kept) > 0, low).otherwise(lowest)).drop(*own)


def merged(one: Column, other: Column) -> Column:
    """Sketch of the union of both documents."""
    return F.sort_array(F.array_union(one, other))


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both, either = F.size(F.array_intersect(one, other)), F.size(F.array_union(one, other))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the first document's shingles that the second one has; null for an empty sketch."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def fingerprint_text(sketched: Column) -> Column:
    """The sketch as text: its hashes in fixed-width hexadecimal, joined."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _bounds(docs: DataFrame, key: str) -> list:
    """Ascending keys that occur in ``docs`` and cut it into ranges of about BUCKET_ROWS rows; the last is the greatest.

    Their number is bounded by MOST_BUCKETS; beyond that the ranges grow, and are sorted on disk. Like any range
    partitioning this looks at a sample of the keys; where the cuts lie changes no result.
    """
    ids = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("k"))
    n = ids.agg(F.count("k")).first()[0]
    if not n:
        return []
    parts = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    shares = [(i + 1) / parts for i in range(parts)]
    sample = ids.sample(min(1.0, SAMPLE_PER_BUCKET * parts / n), seed=1)
    found = sample.agg(F.percentile_approx("k", shares, 4 * parts).alias("q")).first()["q"] or []
    return sorted({*found, ids.agg(F.max("k")).first()[0]})


def _rank(bounds: list, value: Column) -> Column:
    """How many bounds are below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) < value, at + step).otherwise(at),
    )


def with_next(docs: DataFrame, added: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """``docs`` with columns ``added`` of the next document by descending key (ties by text hash; null keys last).

    The document after the last is the first. Each range of keys is sorted by itself; the greatest row of a range is
    also dealt, as a guest, to the range above, where it is the one after the last.
    """
    bounds = _bounds(docs, key)
    k = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY))
    place_key, tie, place, guest, part = own = unused(docs, "next_key", "next_tie", "next_place", "next_guest", "next_part")
    rows = docs.withColumns({place_key: k, tie: F.xxhash64(text_of())})
    rank = _rank(bounds, F.col(place_key))
    at_bound = F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col(place_key)) if bounds else F.lit(False)
    home = F.struct(F.lit(False).alias("guest"), rank.alias("part"))
    visit = F.struct(F.lit(True).alias("guest"), ((rank + 1) % max(1, len(bounds))).alias("part"))
    places = F.when(at_bound, F.array(home, visit)).otherwise(F.array(home))
    dealt = rows.withColumn(place, F.explode(places))
    dealt = dealt.withColumns({guest: F.col(f"{place}.guest"), part: F.col(f"{place}.part")})
    # A guest comes after the rows of the range; in the lowest range these are followed by the greatest of all.
    order = Window.partitionBy(part).orderBy(F.col(guest), F.col(place_key).desc(), tie)
    following = dealt.withColumns({name: F.lead(value).over(order) for name, value in added.items()})
    return following.filter(~F.col(guest)).drop(*own)


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op5: fingerprints of all documents and of their edited texts, and the likeness to the next."""
    from plumbline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    docs = with_sketch(docs, "text", "sketch")
    rows = with_next(docs, {"next_text": F.col("text"), "next_sketch": F.col("sketch")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # Of a single document the next one is itself.
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.coalesce("next_sketch", "sketch").alias("next_sketch"), edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("sketch")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
