"""Row numbers and order statistics per group that survive one huge group.

Both split a group by a bucket that follows the sort order, count rows per bucket,
and sort only inside a bucket, so that no task ever holds a whole group.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1 << 20
# Width for positions that are 64-bit hashes: 4096 buckets of equal share.
HASH_BUCKET = 1 << 52


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which a null key equals a null key."""
    other = right.select(*[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    group: list[str],
    position: str,
    classes: list[Column] | None = None,
    name: str = "row_number",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number the rows of each group 1..n, by ``classes`` and then by ``position``.

    ``classes`` are low-cardinality sort keys (ascending); ``position`` is an integer,
    unique within (group, classes), so one bucket of positions holds at most
    ``rows_per_bucket`` rows whatever the size of the group. Group columns and classes
    must not be null.
    """
    classes = classes or []
    keys = [f"__class{i}" for i in range(len(classes))]
    tagged = df
    for key, expr in zip(keys, classes):
        tagged = tagged.withColumn(key, expr)
    bucket = F.floor(F.col(position) / F.lit(rows_per_bucket)).cast("long")
    # A missing position sorts first, in a bucket below all others.
    tagged = tagged.withColumn("__bucket", F.coalesce(bucket, F.lit(-(1 << 62))))
    slot = [*group, *keys, "__bucket"]
    before = Window.partitionBy(*group).orderBy(*keys, "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*slot)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .drop("__rows")
    )
    inside = Window.partitionBy(*slot).orderBy(position)
    return (
        tagged.join(offsets, slot)
        .withColumn(name, F.col("__offset") + F.row_number().over(inside))
        .drop("__bucket", "__offset", *keys)
    )


def magnitude_bucket(value: Column) -> Column:
    """Monotone bucket, about 0.2 % wide: few thousand buckets for any value range."""
    return F.floor(F.log1p(F.greatest(value, F.lit(0.0))) * F.lit(512.0)).cast("int")


def ranked_values(
    rows: DataFrame,
    histogram: DataFrame,
    by: list[str],
    value: str,
    weight: str,
    positions: dict[str, Column],
) -> DataFrame:
    """Exact values at given 0-based positions of each group's sorted values.

    ``histogram`` has ``by``, ``bucket`` and ``n`` (rows per magnitude bucket);
    ``positions`` gives each wanted position from the group size, column ``total``.
    The first pass finds the bucket of each position, the second one sorts only the
    rows of those buckets; ``rows`` need not be sorted or shuffled as a whole.
    """
    running = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    located = (
        histogram.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    )
    for label, position in positions.items():
        offset = position - F.col("before")
        located = located.withColumn(f"want_{label}", F.when((offset >= 0) & (offset < F.col("n")), offset))
    wants = [f"want_{label}" for label in positions]
    targets = located.filter(F.coalesce(*wants).isNotNull()).select(*by, "bucket", *wants)

    slot = [*by, "bucket"]
    wanted_rows = (
        join_on_keys(rows.withColumn("bucket", magnitude_bucket(F.col(value))), targets, slot)
        .groupBy(*slot, *wants, value)
        .agg(F.sum(weight).alias("n"))
    )
    up_to = Window.partitionBy(*slot).orderBy(value)
    picked = wanted_rows.withColumn("upto", F.sum("n").over(up_to)).withColumn("first", F.col("upto") - F.col("n"))
    return picked.groupBy(*by).agg(
        *[
            F.max(
                F.when((F.col(f"want_{label}") >= F.col("first")) & (F.col(f"want_{label}") < F.col("upto")), F.col(value))
            ).alias(label)
            for label in positions
        ]
    )
