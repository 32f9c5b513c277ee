"""Order of remediation items by what must be done first.

Every item belongs to a topic of its run: an entity, a system's pipeline, a kind of gap, or data quality. Needs are edges
(run_id, topic, needs) between topics: an entity needs the entities that its foreign keys point to, a kind of gap needs the
kinds of ``GAP_NEEDS``. The tier of a topic is the longest chain of needs below it. Tiers are peeled off in rounds: topics
without an open need leave, and their edges with them. What is left when no topic can leave stands on a cycle or needs
one; it has no tier, is told apart by ``cycle``, and comes last in the plan.

A round is a few joins on the edges of all runs at once, stored so that plans stay short; there are as many rounds as the
longest chain. Topics take part once, however many items they have, so a run with a third of all items costs its topics.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grades import SEVERITY_WEIGHTS, choose
from plumbline.operators.ranking import number_rows
from plumbline.sources.folders import stored

# What a kind of gap needs first. Chosen here: the order of kinds is nowhere defined.
GAP_NEEDS = {
    "api_gateway": ["identity_federation"],
    "rest_api": ["api_gateway"],
    "message_queue": ["api_gateway"],
    "data_virtualization": ["rest_api"],
    "semantic_layer": ["etl_pipeline", "data_virtualization"],
}
NODE = ["run_id", "topic"]
NO_TIER = 1 << 30


def entity_topic(entity: Column) -> Column:
    return F.concat(F.lit("entity:"), entity)


def gap_topic(kind: Column) -> Column:
    return F.concat(F.lit("gap:"), kind)


def entity_needs(references: DataFrame) -> DataFrame:
    """Needs of entities from foreign keys: ``run_id``, ``entity``, ``parent``; an entity that points to itself needs nothing."""
    found = references.filter("entity <> parent").select("run_id", entity_topic(F.col("entity")).alias("topic"), entity_topic(F.col("parent")).alias("needs"))
    return found.distinct()


def gap_needs(gaps: DataFrame) -> DataFrame:
    """Needs between the kinds of gaps that a run has; a kind that it lacks is done, and needs nothing."""
    kinds = gaps.select("run_id", "gap_type").distinct()
    table = F.create_map(*[x for kind, first in GAP_NEEDS.items() for x in (F.lit(kind), F.array(*map(F.lit, first)))])
    wanted = kinds.select("run_id", "gap_type", F.explode(F.element_at(table, F.col("gap_type"))).alias("first"))
    there = kinds.withColumnRenamed("gap_type", "first")
    return wanted.join(there, ["run_id", "first"], "left_semi").select("run_id", gap_topic(F.col("gap_type")).alias("topic"), gap_topic(F.col("first")).alias("needs"))


def topic_tiers(topics: DataFrame, needs: DataFrame, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(run_id, topic, tier, cycle) of all topics and of those that are needed: tier 0 needs nothing.

    Without a tier, ``cycle`` is true for topics on a cycle or between two, false for those that only need one.
    """
    edges = store(needs.filter("topic <> needs").select(*NODE, "needs").distinct(), "needs")
    ends = edges.select(*NODE).unionByName(edges.select("run_id", F.col("needs").alias("topic")))
    open_ = store(topics.select(*NODE).unionByName(ends).distinct(), "topics")
    done: list[DataFrame] = []
    while True:
        ready = store(open_.join(edges.select(*NODE).distinct(), NODE, "left_anti"), "ready")
        if ready.isEmpty():
            break
        done.append(ready.withColumns({"tier": F.lit(len(done)), "cycle": F.lit(False)}))
        open_ = store(open_.join(ready, NODE, "left_anti"), "topics")
        edges = store(edges.join(ready.withColumnRenamed("topic", "needs"), ["run_id", "needs"], "left_anti"), "needs")
    # From the other end: topics that no topic left needs are not on a cycle.
    core = edges
    while True:
        unneeded = core.join(core.select("run_id", F.col("needs").alias("topic")).distinct(), NODE, "left_anti")
        if unneeded.isEmpty():
            break
        core = store(core.join(unneeded.select(*NODE).distinct(), NODE, "left_anti"), "core")
    on = core.select(*NODE).distinct().withColumn("on", F.lit(True))
    left = open_.join(on, NODE, "left").select(*NODE, F.lit(None).cast("int").alias("tier"), F.coalesce("on", F.lit(False)).alias("cycle"))
    return reduce(DataFrame.unionByName, [*done, left])


def tier_counts(tiers: DataFrame) -> DataFrame:
    """Topics per run and tier; a null tier for those that wait for a cycle."""
    return tiers.groupBy("run_id", "tier").agg(F.count(F.lit(1)).alias("topics"), F.count_if("cycle").alias("on_cycle"))


def tiered_plan(items: DataFrame, tiers: DataFrame, needs: DataFrame, item_id: Callable[..., Column] | None = None) -> DataFrame:
    """Items numbered per run by tier, then severity, priority, kind and input order, with their prerequisites.

    The prerequisites of an item are the last items, in this order, of the topics that its own topic needs: when they are
    done, these topics are. A topic that needs a cycle, or stands on it, names only prerequisites that have a tier.

    Items of a topic share its tier, so its last item is known before any are numbered, and lists of prerequisites come to
    the items with the tiers. ``item_id`` makes the id of ``run_id``, ``kind_ord`` and ``input_ord`` (such as that of
    ``remediation``); ids are then worked out at the end, and no row carries them. Without it, ``items`` has them.
    """
    order = [-choose(F.col("severity"), SEVERITY_WEIGHTS, 3), -F.col("priority"), F.col("kind_ord")]
    carried = [] if item_id is not None else ["item_id"]
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], "input_ord", "kind_ord", *carried)
    last = items.groupBy(*NODE).agg(F.max(place).alias("last"))
    sound = tiers.filter("tier IS NOT NULL").select(*NODE)
    ends = last.join(sound, NODE, "left_semi").withColumnRenamed("topic", "needs").select("run_id", "needs", "last.kind_ord", "last.input_ord", *[f"last.{c}" for c in carried])
    own = F.struct("kind_ord", "input_ord") if item_id is not None else F.col("item_id")
    first = needs.filter("topic <> needs").join(ends, ["run_id", "needs"]).withColumn("own", own)
    lists = first.groupBy(*NODE).agg(F.collect_set("own").alias("first"))
    topics = tiers.select(*NODE, "tier", "cycle").join(lists, NODE, "left")
    classes = [F.coalesce("tier", F.lit(NO_TIER)), *order]
    numbered = number_rows(items.join(topics, NODE), ["run_id"], "input_ord", classes, "recommended_sequence")
    ids = F.col("first")
    if item_id is not None:
        numbered = numbered.withColumn("item_id", item_id(F.col("run_id"), F.col("kind_ord"), F.col("input_ord")))
        ids = F.transform("first", lambda x: item_id(F.col("run_id"), x["kind_ord"], x["input_ord"]))
    none = F.array().cast("array<string>")
    return numbered.withColumn("prerequisites", F.array_sort(F.coalesce(ids, none))).drop("first")


def open_prerequisites(plan: DataFrame) -> DataFrame:
    """Items of a plan that come before one of their prerequisites; none in a sound plan."""
    need = plan.select("run_id", "item_id", "recommended_sequence", F.explode("prerequisites").alias("first"))
    place = plan.select("run_id", F.col("item_id").alias("first"), F.col("recommended_sequence").alias("place"))
    return need.join(place, ["run_id", "first"]).filter("place >= recommended_sequence").select("run_id", "item_id", "first")


def critical_chain(plan: DataFrame) -> DataFrame:
    """Per run: number of tiers, and the days that remain if all items of a tier are worked on at once."""
    longest = plan.filter("tier IS NOT NULL").groupBy("run_id", "tier").agg(F.max("effort_min_days").alias("low"), F.max("effort_max_days").alias("high"))
    return longest.groupBy("run_id").agg(F.count(F.lit(1)).alias("tiers"), F.sum("low").alias("min_days"), F.sum("high").alias("max_days"))
