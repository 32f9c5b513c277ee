"""Sharding by a two-pass external shuffle.

Pass 1 scatters every record by seeded hashes: the shard is the highest of one hash per shard (so a further shard takes
records only into itself and none move between the old ones), and inside the shard a second hash picks one of its
buckets, whose number follows from the data so that a bucket fits into memory. Pass 2 shuffles each bucket with Fisher
and Yates' exchanges (Spark's ``shuffle``) and numbers its records after those of the shard's earlier buckets, which
makes the slots of a shard gapless. The permutation is applied to row numbers of a bucket; texts are moved once, sorted on
disk where needed, and never gathered into one row.

Defined cases: the shard of a record depends on its key, the seed and the number of shards alone; records with a null key
share a shard but not a bucket; repeated rows get a slot each; a null text counts as no bytes; extra columns are kept,
columns that carry a name of the result are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import text_of, unused

BUCKET_BYTES = 8 << 20
RECORD_OVERHEAD = 8
_RESULT = ("size", "shard", "slot", "grown_shard")


def _weight(key: Column, shard: int, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed), F.lit(shard))


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard with the highest hash of (key, seed, shard); the lower number on a tie."""
    best = reduce(lambda a, b: F.greatest(a, b), [F.struct(_weight(key, k, seed).alias("w"), F.lit(-k).alias("k")) for k in range(shards)])
    return -best["k"]


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead."""
    return (F.octet_length(text_of(text)) + RECORD_OVERHEAD).cast("long")


def assign(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with size, shard, slot (gapless per shard) and the shard if there were one more."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _RESULT])
    k = F.col(f"`{key}`")
    rows = rows.withColumns({"size": record_size(text), "shard": shard_of(k, shards, seed)})
    grown = F.greatest(*[_weight(k, s, seed) for s in range(shards)]) if shards > 1 else _weight(k, 0, seed)
    rows = rows.withColumn("grown_shard", F.when(_weight(k, shards, seed) > grown, F.lit(shards)).otherwise(F.col("shard")))
    total = docs.select(record_size(text).alias("size")).agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    part = F.pmod(F.xxhash64(k, F.lit(seed + 1), text_of(text)), F.lit(per_shard))
    # Its own columns go by names that the caller's do not have.
    own = unused(rows, "bucket", "row_in_bucket", "first_slot", "permutation")
    return _numbered(rows.withColumn(own[0], F.col("shard").cast("long") * per_shard + part), k, text, seed, own)


def _numbered(rows: DataFrame, key: Column, text: str, seed: int, own: list[str]) -> DataFrame:
    """Pass 2: a seeded permutation of each bucket's row numbers, after the rows of the shard's earlier buckets."""
    from pyspark.sql import Window

    bucket, place, first, permutation = own
    counts = rows.groupBy("shard", bucket).agg(F.count(F.lit(1)).cast("int").alias("n"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # Sorted, so that a task that runs again draws the same permutations.
    buckets = counts.withColumn(first, F.coalesce(F.sum("n").over(before), F.lit(0))).sortWithinPartitions(bucket)
    permuted = buckets.select(bucket, first, F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), seed).alias(permutation))
    order = Window.partitionBy(bucket).orderBy(key, F.xxhash64(text_of(text)))
    numbered = rows.withColumn(place, F.row_number().over(order) - 1)
    slot = F.col(first) + F.get(permutation, F.col(place))
    return numbered.join(permuted, bucket).withColumn("slot", slot.cast("long")).drop(*own)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, written by as many tasks as hold its buckets; the rows of a file are in slot order."""
    assigned.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, schema: StructType) -> DataFrame:
    """The records of written shards; ``schema`` is that of the assigned rows."""
    return spark.read.schema(schema).parquet(path)


def query(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """Registered query op1: all documents written to 24 shards, law ``key``, and read back from the files."""
    from plumbline.llm.common import shared_folder, table

    rows = assign(table(spark, sf_dir, "documents").select("doc_id", "text"), shards)
    path = f"{shared_folder(spark, 'shards')}/shards"
    write_shards(rows, path)
    crc = F.crc32(text_of().cast("binary"))
    # What the files hold, and not what was meant to be written.
    written = read_shards(spark, path, rows.schema)
    return written.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
