"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

SALTS = 8


def salted_join(rows: DataFrame, few: DataFrame, on: str, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on a column that many rows may share: ``few`` has one row per value and meets its rows in ``salts`` parts."""
    many = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [on, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b) in the table: root is the least node of its component.

    Rounds of hooking and contraction: every root hooks to its least neighbouring root, chains of hooks are shortened, and
    edges are carried over to the roots until none is left. Each round's tables are stored in the shared folder.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
        hooks = written(hooks, "hooks")
        for _ in range(2):
            # Only roots that hook and are hooked to make a chain.
            above = hooks.join(hooks.select(F.col("up").alias("root")).distinct(), "root", "left_semi")
            above = above.select(F.col("root").alias("up"), F.col("up").alias("top"))
            hooks = written(salted_join(hooks, above, "up", F.col("root"), "left").select("root", F.coalesce("top", "up").alias("up")), "hooks")
        moved = salted_join(labels, hooks, "root", F.col("node"), "left")
        labels = written(moved.select("node", F.coalesce("up", "root").alias("root")), "labels")
        a = salted_join(edges, hooks.withColumnsRenamed({"root": "a", "up": "ua"}), "a", F.col("b"), "left")
        both = salted_join(a, hooks.withColumnsRenamed({"root": "b", "up": "ub"}), "b", F.col("a"), "left")
        ends = both.select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).filter("x <> y")
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
