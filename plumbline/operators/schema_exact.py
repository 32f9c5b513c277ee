"""Cross-system comparison of entities by exact field names."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import messages
from plumbline.functions.text import fill
from plumbline.functions.types import (
    OTHER_TYPE,
    SAME_GROUP,
    SAME_TYPE,
    UNKNOWN_TYPE,
    type_group,
    type_key,
)
from plumbline.operators.predicates import active, requested_entities
from plumbline.operators.schema_fuzzy import by_entity, entity_systems, led_fields

PAIR = ["entity", "source_system", "target_system"]
WORD = 64  # systems of one word of a presence bitmap


def _named(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("field") != "")


def canonical_schema(catalog: DataFrame) -> DataFrame:
    """Union of an entity's fields; type and key come from the first system that has it.

    A canonical field is nullable when some system of the entity lacks it.
    """
    dealt = by_entity(catalog)
    systems = entity_systems(dealt).groupBy("entity").agg(F.count(F.lit(1)).alias("system_count"))
    first = F.struct(F.coalesce(F.col("type"), F.lit("unknown")).alias("type"), F.coalesce(F.col("pk"), F.lit(False)).alias("pk"))
    return (
        led_fields(_named(dealt))
        .groupBy("lead", "entity", "field")
        .agg(F.count(F.lit(1)).alias("present_in"), F.min_by(first, "system_ord").alias("d"))
        .join(systems.hint("shuffle_hash"), "entity")
        .select(
            "entity",
            "field",
            F.col("d.type").alias("data_type"),
            (F.col("present_in") < F.col("system_count")).alias("nullable"),
            F.col("d.pk").alias("is_primary_key"),
        )
    )


def field_mapping(catalog: DataFrame) -> DataFrame:
    """Every field of the earlier system against each later system of the entity.

    Fields that only the later system has are left out. Keys and groups of types are worked out once a field, not once a pair.
    """
    dealt = by_entity(catalog)
    fields = led_fields(_named(dealt)).withColumns({"t": type_key(F.col("type")), "g": type_group(F.col("type"))})
    later = entity_systems(dealt).select("entity", F.col("system").alias("target_system"), F.col("system_ord").alias("target_ord"))
    source = fields.select(
        "lead", "entity", F.col("system").alias("source_system"), F.col("system_ord").alias("source_ord"), "field", F.col("t").alias("source_key"), F.col("g").alias("source_group")
    )
    target = fields.select("lead", "entity", F.col("system").alias("target_system"), "field", "t", "g", F.lit(True).alias("both"))
    same_type, same_group = F.col("source_key") == F.col("t"), F.col("source_group") == F.col("g")
    unknown = F.col("source_key").isNull() | F.col("t").isNull()
    score = F.when(unknown, UNKNOWN_TYPE).when(same_type, SAME_TYPE).when(same_group, SAME_GROUP).otherwise(OTHER_TYPE)
    return (
        source.join(later.hint("shuffle_hash"), "entity")
        .filter(F.col("source_ord") < F.col("target_ord"))
        .join(target, ["lead", "entity", "target_system", "field"], "left")
        .withColumn("similarity_score", F.when(F.col("both"), score).otherwise(F.lit(0.0)))
        .select(
            *PAIR,
            F.col("field").alias("source_field"),
            F.when(F.col("both"), F.col("field")).otherwise(F.lit("")).alias("target_field"),
            "similarity_score",
            F.when(F.col("both").isNull(), "unmapped").when(F.col("similarity_score") >= SAME_GROUP, "exact").otherwise("semantic").alias("mapping_type"),
        )
    )


def consistency_score(catalog: DataFrame) -> DataFrame:
    """Mean mapping score per entity, 1.0 without mappings.

    Scores take five values, so they are counted and weighted; the mean is then the same for any order of rows. Pairs
    are counted and never made: each field counts the earlier systems that have it, that also know its type, whose type
    is of its group, and whose type is its own. Rows are dealt once, into more tasks than a merge by size would leave, and
    come sorted for the first two.
    """
    dealt = by_entity(catalog)
    rows = led_fields(_named(dealt)).select("lead", "entity", "field", "system_ord", type_group(F.col("type")).alias("g"), type_key(F.col("type")).alias("t"))
    before = lambda *of: Window.partitionBy("lead", "entity", "field", *of).orderBy("system_ord").rangeBetween(Window.unboundedPreceding, -1)
    known = F.col("t").isNotNull()
    found = rows.select("*", F.count(F.lit(1)).over(before()).alias("all"), F.when(known, F.count("t").over(before())).otherwise(F.lit(0)).alias("known"))
    pairs = found.select(
        "entity",
        "all",
        "known",
        F.when(known, F.count(F.lit(1)).over(before("g"))).otherwise(F.lit(0)).alias("group"),
        F.when(known, F.count(F.lit(1)).over(before("g", "t"))).otherwise(F.lit(0)).alias("same"),
    )
    counts = pairs.groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("all", "known", "group", "same")])
    classes = [
        (SAME_TYPE, F.col("same")),
        (SAME_GROUP, F.col("group") - F.col("same")),
        (UNKNOWN_TYPE, F.col("all") - F.col("known")),
        (OTHER_TYPE, F.col("known") - F.col("group")),
    ]
    total = F.lit(0.0)
    for value, count in classes:
        total = total + count * F.lit(value)
    # Every field of a system is mapped to each later system of the entity.
    later = Window.partitionBy("entity").orderBy("system_ord").rangeBetween(1, Window.unboundedFollowing)
    own = dealt.select("entity", "system", "system_ord", F.when(F.col("field") != "", F.col("field")).alias("field")).distinct()
    sizes = own.groupBy("entity", "system", "system_ord").agg(F.count("field").alias("n")).withColumn("later", F.count(F.lit(1)).over(later))
    mappings = sizes.groupBy("entity").agg(F.sum(F.col("n") * F.col("later")).alias("mappings"))
    return mappings.join(counts, "entity", "left").select(
        "entity",
        "mappings",
        F.when(F.col("mappings") > 0, F.coalesce(total, F.lit(0.0)) / F.col("mappings")).otherwise(F.lit(1.0)).alias("consistency_score"),
    )


ABSENT, DIFFERENT = "missing_field", "type_mismatch"  # kinds of findings
BARE = [*PAIR, "inconsistency_type", "field", "source_definition", "target_definition", "severity"]


def described(bare: DataFrame) -> DataFrame:
    """Bare findings with their texts."""
    names = {
        "field": F.col("field"),
        "source": F.col("source_system"),
        "target": F.col("target_system"),
        "source_type": F.col("source_definition"),
        "target_type": F.col("target_definition"),
    }
    absent = F.col("inconsistency_type") == ABSENT
    return bare.select(
        *PAIR,
        "inconsistency_type",
        F.col("field").alias("field_name"),
        "source_definition",
        "target_definition",
        "severity",
        F.when(absent, fill(messages.ABSENT_IMPACT, **names)).otherwise(fill(messages.TYPE_IMPACT, **names)).alias("impact_description"),
        F.when(absent, fill(messages.ABSENT_HINT, **names)).otherwise(fill(messages.TYPE_HINT, **names)).alias("remediation_hint"),
    )


def _system_words(catalog: DataFrame) -> DataFrame:
    """Systems of every entity in words of 64 bits: (entity, word, everyone, names), names in the order of their bits."""
    number = F.row_number().over(Window.partitionBy("entity").orderBy("system")) - 1
    systems = catalog.select("entity", "system").distinct().withColumn("number", number)
    bit = (F.col("number") % WORD).cast("int").alias("bit")
    named = F.array_sort(F.collect_list(F.struct("bit", "system")))
    return (
        systems.select("entity", F.floor(F.col("number") / WORD).cast("int").alias("word"), bit, "system")
        .groupBy("entity", "word")
        .agg(F.bit_or(_mask(F.col("bit"))).alias("everyone"), F.transform(named, lambda x: x["system"]).alias("names"))
    )


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _lacking_fields(catalog: DataFrame) -> DataFrame:
    """Fields that some system of the entity lacks, once for each word of its systems, with the field's own bit in ``has``.

    Everything is dealt by entity and sorted by ``lead``, entity and field; what is known of an entity is looked up by it.
    """
    dealt = by_entity(catalog)
    size = dealt.select("entity", "system").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("systems"))
    in_systems = F.count(F.lit(1)).over(Window.partitionBy("lead", "entity", "field"))
    lacking = led_fields(_named(dealt)).withColumn("n", in_systems).join(size.hint("shuffle_hash"), "entity").filter("n < systems")
    place = F.array_position("names", F.col("system"))
    own = F.when(place > 0, _mask((place - 1).cast("int"))).otherwise(F.lit(0))
    return lacking.drop("n", "systems").join(_system_words(dealt).hint("shuffle_hash"), "entity").withColumn("has", own)


def _absent(lacking: DataFrame) -> DataFrame:
    """``absent``, the names of the word that are not in ``present``."""
    rest = F.col("everyone").bitwiseAND(F.bitwise_not("present"))
    return lacking.withColumn("rest", rest).filter("rest <> 0").withColumn("absent", F.filter("names", lambda x, i: F.getbit("rest", i) == 1))


def absent_systems(catalog: DataFrame) -> DataFrame:
    """(entity, field, absent): the systems of the entity that lack the field; no row where none does.

    Presence is a bitmap of systems per field, and what is absent is its complement within the entity's systems. A field
    has a row for each word of 64 systems in which one lacks it.
    """
    words = _lacking_fields(catalog).groupBy("lead", "entity", "field", "word")
    masks = words.agg(F.bit_or("has").alias("present"), F.first("everyone").alias("everyone"), F.first("names").alias("names"))
    return _absent(masks).select("entity", "field", "absent")


def missing_field_findings(catalog: DataFrame) -> DataFrame:
    """A finding for each system that has a field and each system of the entity that lacks it."""
    return described(_bare_missing(catalog))


def _bare_missing(catalog: DataFrame) -> DataFrame:
    present = F.bit_or("has").over(Window.partitionBy("lead", "entity", "field", "word"))
    return (
        _absent(_lacking_fields(catalog).withColumn("present", present))
        .withColumnRenamed("system", "source_system")
        .withColumn("target_system", F.explode("absent"))
        .withColumn("inconsistency_type", F.lit(ABSENT))
        .withColumn("source_definition", F.to_json(F.struct(F.col("field").alias("name"), "type", "nullable", "pk")))
        .withColumn("target_definition", F.lit(None).cast("string"))
        .withColumn("severity", F.when(F.coalesce(F.col("pk"), F.lit(False)), "HIGH").otherwise("MEDIUM"))
        .select(*BARE)
    )


def type_mismatch_findings(catalog: DataFrame) -> DataFrame:
    """A finding for each pair of systems whose types of the same field differ in kind."""
    return described(_bare_mismatches(catalog))


def _bare_mismatches(catalog: DataFrame) -> DataFrame:
    """Rows are dealt and sorted once. Fields with types of one group only are told by a window and left out before anything
    is joined, and a type meets only other groups.
    """
    same_field = Window.partitionBy("lead", "entity", "field")
    typed = led_fields(by_entity(_named(catalog))).withColumn("g", type_group(F.col("type"))).filter("g IS NOT NULL")
    some = F.xxhash64("g")
    mixed = typed.withColumn("mixed", F.min(some).over(same_field) < F.max(some).over(same_field)).filter("mixed")
    source = (
        mixed.withColumn("groups", F.collect_set("g").over(same_field))
        .withColumn("g", F.explode(F.array_remove("groups", F.col("g"))))
        .select("lead", "entity", "field", "g", F.col("system").alias("source_system"), F.col("system_ord").alias("source_ord"), F.col("type").alias("source_definition"))
    )
    target = mixed.select(
        "lead", "entity", "field", "g", F.col("system").alias("target_system"), F.col("system_ord").alias("target_ord"), F.col("type").alias("target_definition")
    )
    differing = source.join(target, ["lead", "entity", "field", "g"]).filter(F.col("source_ord") < F.col("target_ord"))
    return differing.withColumns({"inconsistency_type": F.lit(DIFFERENT), "severity": F.lit("HIGH")}).select(*BARE)


def bare_findings(catalog: DataFrame) -> DataFrame:
    return _bare_missing(catalog).unionByName(_bare_mismatches(catalog))


def findings(catalog: DataFrame) -> DataFrame:
    return described(bare_findings(catalog))


def analyze_schemas(catalog: DataFrame, systems: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """Full comparison over connected systems and requested entities.

    Returns ``canonical``, ``mappings``, ``consistency`` and ``inconsistencies``.
    """
    connected = active(systems).select(F.col("name").alias("system"))
    scope = requested_entities(catalog.join(connected, "system", "left_semi"), entities)
    return {
        "canonical": canonical_schema(scope),
        "mappings": field_mapping(scope),
        "consistency": consistency_score(scope),
        "inconsistencies": findings(scope),
    }
