"""Cross-system comparison of entities by similar field names.

Input is a field catalog: one row per field with ``system``, ``system_ord``, ``entity``,
``field``, ``field_ord``, ``type``, ``nullable``, ``pk``. Entities are matched by exact
name; a row with a null field says that the system has the entity without fields.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import messages
from plumbline.functions.grades import severity_rank
from plumbline.functions.names import looks_like_id, normalize_field_name
from plumbline.functions.text import fill
from plumbline.functions.types import bases_compatible, type_base
from plumbline.operators.similar_names import candidate_pairs, score_pairs

THRESHOLD = 0.8
PAIR = ["entity", "source_system", "target_system"]


def unique_fields(catalog: DataFrame) -> DataFrame:
    """One row per field name: the first position, the last definition."""
    return led_fields(catalog).drop("lead")


def led_fields(catalog: DataFrame) -> DataFrame:
    """The unique fields with ``lead``, a hash of entity and field.

    Rows are sorted by the first eight bytes of their first key, which names of entities mostly share; the hash goes before.
    On a catalog dealt by entity they come out sorted by lead, entity, field and system_ord, for windows and joins on these.
    """
    definition = F.struct("type", "nullable", "pk")
    key = ["lead", "entity", "field", "system_ord", "system"]
    return (
        catalog.filter(F.col("field").isNotNull())
        .withColumn("lead", F.xxhash64("entity", "field"))
        .groupBy(*key)
        .agg(F.min("field_ord").alias("field_ord"), F.max_by(definition, "field_ord").alias("d"))
        .select("system", "system_ord", "entity", "field", "field_ord", "d.type", "d.nullable", "d.pk", "lead")
    )


def entity_systems(catalog: DataFrame) -> DataFrame:
    return catalog.select("entity", "system", "system_ord").distinct()


def shared_entities(catalog: DataFrame) -> DataFrame:
    """Entities present in more than one system."""
    return (
        entity_systems(catalog)
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("system_count"))
        .filter(F.col("system_count") > 1)
    )


def system_pairs(catalog: DataFrame) -> DataFrame:
    """Pairs of systems of each shared entity; the earlier declared one is the source."""
    systems = entity_systems(catalog)
    source = systems.select("entity", F.col("system").alias("source_system"), F.col("system_ord").alias("source_ord"))
    target = systems.select("entity", F.col("system").alias("target_system"), F.col("system_ord").alias("target_ord"))
    return source.join(target, "entity").filter(F.col("source_ord") < F.col("target_ord"))


def _source_fields(catalog: DataFrame, fields: DataFrame) -> DataFrame:
    """Every source field against every later system that has the entity."""
    later = entity_systems(catalog).select(
        "entity", F.col("system").alias("target_system"), F.col("system_ord").alias("target_ord")
    )
    source = fields.select(
        "entity",
        F.col("system").alias("source_system"),
        F.col("system_ord").alias("source_ord"),
        F.col("field").alias("source_field"),
        F.col("field_ord").alias("source_field_ord"),
        F.col("type").alias("source_type"),
        F.col("nullable").alias("source_nullable"),
        F.col("pk").alias("source_pk"),
        F.col("norm").alias("source_norm"),
        F.col("base").alias("source_base"),
    )
    return source.join(later, "entity").filter(F.col("source_ord") < F.col("target_ord"))


def _target_names(fields: DataFrame) -> DataFrame:
    """The earliest field of each normalised name: it wins every tie among equal names."""
    target = F.struct("field", "field_ord", "type", "nullable", "pk", "base")
    return fields.groupBy("entity", F.col("system").alias("target_system"), F.col("norm").alias("target_norm")).agg(
        F.min_by(target, "field_ord").alias("target")
    )


def compare_fields(
    catalog: DataFrame,
    threshold: float | None = THRESHOLD,
    store: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Best target field of every source field, per entity and pair of systems.

    Equal normalised names match whatever the threshold; the other fields take the
    target with the highest ratio >= ``threshold``, the earliest one on ties. Targets
    may serve several sources. Unmatched source fields have a null ``target_field``.
    ``threshold=None`` matches equal names only. ``store`` (such as ``folders.stored``)
    writes intermediate results that are used several times.
    """
    store = store or (lambda df, label: df)
    prepared = unique_fields(catalog).withColumns(
        {"norm": normalize_field_name(F.col("field")), "base": type_base(F.coalesce(F.col("type"), F.lit("")))}
    )
    fields = store(prepared, "fields")
    if threshold is None:
        equal = _target_names(fields).withColumnRenamed("target_norm", "source_norm").withColumn("score", F.lit(1.0))
        compared = _source_fields(catalog, fields).join(equal, ["entity", "target_system", "source_norm"], "left")
    else:
        placed = by_entity(fields)
        sources = _source_fields(catalog, placed)
        best = _best_targets(placed, similar_names_of(fields, threshold, store))
        # Hashes lead the keys: rows are sorted by their first eight bytes, which names of entities mostly share.
        lead = lambda *of: F.xxhash64("entity", "target_system", *of)
        details = _target_names(placed).select("entity", "target_system", "target", _name_key("target_norm"), F.col("target.field_ord").alias("best_ord"))
        by_name, by_place = ["lead", "entity", "target_system", "source_norm"], ["lead", "entity", "target_system", "best_ord", "name_key"]
        found = sources.withColumn("lead", lead("source_norm")).join(best.withColumn("lead", lead("source_norm")), by_name, "left").drop("lead")
        compared = found.withColumn("lead", lead("best_ord", "name_key")).join(details.withColumn("lead", lead("best_ord", "name_key")), by_place, "left")
    matched = F.col("target").isNotNull()
    return compared.select(
        *PAIR,
        "source_ord",
        "target_ord",
        "source_field",
        "source_field_ord",
        "source_type",
        "source_nullable",
        "source_pk",
        F.col("target.field").alias("target_field"),
        F.col("target.field_ord").alias("target_field_ord"),
        F.col("target.type").alias("target_type"),
        F.col("target.nullable").alias("target_nullable"),
        F.col("target.pk").alias("target_pk"),
        "score",
        F.when(matched, ~bases_compatible(F.col("source_base"), F.col("target.base"))).alias("type_mismatch"),
    )


def by_entity(rows: DataFrame) -> DataFrame:
    """Rows dealt by entity: what follows, up to the compared fields, is keyed by entity and more, and moves no row again.

    Joins may then use that distribution although they have more keys, which Spark's setting rules out by default.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Fields become many times as many rows where they are compared, so partitions are not merged by their size in bytes.
    return rows.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "entity")


def _name_key(norm: str):
    return F.xxhash64(norm).alias("name_key")


def similar_names_of(fields: DataFrame, threshold: float, store: Callable) -> DataFrame:
    """The dictionary: pairs of names of the whole catalog that reach ``threshold``, each scored once; equal names have 1."""
    names = fields.select("norm").distinct()
    sources, targets = names.withColumnRenamed("norm", "source_norm"), names.withColumnRenamed("norm", "target_norm")
    different = score_pairs(candidate_pairs(sources, targets, threshold, []), threshold).select("source_norm", "target_norm", "score")
    equal = names.select(F.col("norm").alias("source_norm"), F.col("norm").alias("target_norm"), F.lit(1.0).alias("score"))
    return store(different.unionByName(equal), "similar_names")


def _best_targets(fields: DataFrame, scored: DataFrame) -> DataFrame:
    """The best target of every name that an entity's target system has, or has one similar to: an equal name wins.

    It depends on the source's name and the target system alone, so it is looked for once per name and not once per
    source system. Of equal scores the earliest field is taken: score and place are one number, so that the aggregation
    keeps numbers only and needs no sorting. The target is named by its place and a hash of its name.
    """
    key = ["entity", F.col("system").alias("target_system")]
    first = fields.groupBy(*key, F.col("norm").alias("target_norm")).agg(F.min("field_ord").alias("ord"))
    steps = F.floor(F.col("score") * F.lit(float(1 << 53))).cast("decimal(17,0)") * F.lit(1 << 62).cast("decimal(19,0)")
    ranked = scored.select("source_norm", "target_norm", "score", steps.alias("steps"), _name_key("target_norm"))
    met = first.join(ranked, "target_norm").withColumn("rank", F.col("steps") - F.col("ord").cast("decimal(19,0)"))
    return met.groupBy("entity", "target_system", "source_norm").agg(
        F.max("score").alias("score"), F.max_by("ord", "rank").alias("best_ord"), F.max_by("name_key", "rank").alias("name_key")
    )


def field_matches(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("target_field").isNotNull())


def matched_type_mismatches(compared: DataFrame) -> DataFrame:
    return compared.filter("type_mismatch").select(*PAIR, "source_field", "source_type", "target_type")


def missing_in_target(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("target_field").isNull()).select(
        *PAIR, F.col("source_field").alias("field"), F.col("source_field_ord").alias("field_ord")
    )


def missing_in_source(catalog: DataFrame, compared: DataFrame) -> DataFrame:
    """Target fields that no source field was matched with."""
    earlier = entity_systems(catalog).select(
        "entity", F.col("system").alias("source_system"), F.col("system_ord").alias("source_ord")
    )
    wanted = (
        by_entity(unique_fields(catalog).select("entity", F.col("system").alias("target_system"), "system_ord", "field", "field_ord"))
        .join(earlier, "entity")
        .filter(F.col("source_ord") < F.col("system_ord"))
    )
    taken = by_entity(field_matches(compared).select(*PAIR, F.col("target_field").alias("field")))
    return wanted.join(taken, [*PAIR, "field"], "left_anti").select(*PAIR, "field", "field_ord")


def missing_fields(catalog: DataFrame, compared: DataFrame) -> DataFrame:
    """Unmatched fields of both sides, told apart by ``side``."""
    return (
        missing_in_target(compared)
        .withColumn("side", F.lit("missing_in_target"))
        .unionByName(missing_in_source(catalog, compared).withColumn("side", F.lit("missing_in_source")))
    )


def schema_similarity(catalog: DataFrame, compared: DataFrame) -> DataFrame:
    """Per entity and pair: matches, mismatches and overall similarity."""
    sizes = unique_fields(catalog).groupBy("entity", "system").agg(F.count(F.lit(1)).alias("n"))
    source = sizes.select("entity", F.col("system").alias("source_system"), F.col("n").alias("source_fields"))
    target = sizes.select("entity", F.col("system").alias("target_system"), F.col("n").alias("target_fields"))
    counts = compared.groupBy(*PAIR).agg(
        F.count("target_field").alias("matched"), F.count_if("type_mismatch").alias("mismatched")
    )
    largest = F.greatest("source_fields", "target_fields", F.lit(1))
    return (
        system_pairs(catalog)
        .join(source, ["entity", "source_system"], "left")
        .join(target, ["entity", "target_system"], "left")
        .join(counts, PAIR, "left")
        .na.fill(0, ["source_fields", "target_fields", "matched", "mismatched"])
        .select(
            *PAIR,
            "source_fields",
            "target_fields",
            "matched",
            "mismatched",
            F.greatest(F.lit(0.0), (F.col("matched") - F.col("mismatched") * F.lit(0.5)) / largest).alias(
                "overall_similarity"
            ),
        )
    )


def key_mismatches(compared: DataFrame) -> DataFrame:
    """Pairs whose matched id-like fields have different raw names on the two sides.

    Sets are compared by counting in how many names one side alone occurs.
    """
    side = lambda name, s: F.struct(F.col(name).alias("name"), F.lit(s).alias("s"), F.lit(1 - s).alias("t"))
    names = (
        field_matches(compared)
        .filter(looks_like_id(F.col("source_field")) | looks_like_id(F.col("target_field")))
        .select(*PAIR, "source_ord", "target_ord", F.inline(F.array(side("source_field", 1), side("target_field", 0))))
        .filter(looks_like_id(F.col("name")))
        .groupBy(*PAIR, "source_ord", "target_ord", "name")
        .agg(F.max("s").alias("s"), F.max("t").alias("t"))
    )
    return (
        names.groupBy(*PAIR, "source_ord", "target_ord")
        .agg(F.max("s").alias("s"), F.max("t").alias("t"), F.max((F.col("s") != F.col("t")).cast("int")).alias("differ"))
        .filter((F.col("s") == 1) & (F.col("t") == 1) & (F.col("differ") == 1))
        .drop("s", "t", "differ")
    )


def _quoted(name):
    """A name in single quotes; in double quotes if it has single ones only."""
    single, double = F.lit("'"), F.lit('"')
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), single, F.lit("\\'"))
    return F.when(F.contains(name, single) & ~F.contains(name, double), F.concat(double, F.replace(name, F.lit("\\"), F.lit("\\\\")), double)).otherwise(
        F.concat(single, escaped, single)
    )


def _name_list(name, order):
    ordered = F.transform(
        F.array_sort(F.collect_list(F.when(looks_like_id(F.col(name)), F.struct(F.col(order), F.col(name).alias("n"))))),
        lambda x: _quoted(x["n"]),
    )
    return F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]"))


def inconsistency_report(compared: DataFrame, ordered: bool = False) -> DataFrame:
    """Missing target fields (HIGH), type mismatches (MEDIUM), key mismatches (CRITICAL).

    Fields missing in the source are not reported. ``finding_ord`` orders the findings
    of one pair as they are found; ``ordered`` sorts the whole report by severity.
    """
    names = {
        "field": F.col("source_field"),
        "source": F.col("source_system"),
        "target": F.col("target_system"),
        "source_type": F.col("source_type"),
        "target_type": F.col("target_type"),
    }
    missing = F.col("target_field").isNull()
    per_field = compared.filter(missing | F.col("type_mismatch")).select(
        *PAIR,
        "source_ord",
        "target_ord",
        F.when(missing, "missing_field").otherwise("type_mismatch").alias("kind"),
        F.when(missing, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(missing, fill(messages.FIELD_MISSING, **names))
        .otherwise(fill(messages.FIELD_TYPES_DIFFER, **names))
        .alias("detail"),
        F.col("source_field").alias("field_name"),
        F.col("source_field_ord").cast("long").alias("finding_ord"),
    )
    lists = (
        field_matches(compared)
        .filter(looks_like_id(F.col("source_field")) | looks_like_id(F.col("target_field")))
        .join(key_mismatches(compared).select(*PAIR), PAIR, "left_semi")
        .groupBy(*PAIR, "source_ord", "target_ord")
        .agg(_name_list("source_field", "source_field_ord").alias("src"), _name_list("target_field", "source_field_ord").alias("tgt"))
    )
    keys = lists.select(
        *PAIR,
        "source_ord",
        "target_ord",
        F.lit("key_mismatch").alias("kind"),
        F.lit("CRITICAL").alias("severity"),
        fill(messages.KEYS_DIFFER, source_keys=F.col("src"), target_keys=F.col("tgt")).alias("detail"),
        F.lit(None).cast("string").alias("field_name"),
        F.lit(-1).cast("long").alias("finding_ord"),
    )
    report = per_field.unionByName(keys)
    if ordered:
        report = report.orderBy(
            severity_rank(F.col("severity")), "entity", "source_ord", "target_ord", "kind", "finding_ord"
        )
    return report


def nullability_differences(compared: DataFrame) -> DataFrame:
    """Extension: matched fields that only one side allows to be null."""
    return field_matches(compared).filter(F.col("source_nullable") != F.col("target_nullable")).select(
        *PAIR, "source_field", "target_field", "source_nullable", "target_nullable"
    )


def key_type_mismatches(compared: DataFrame) -> DataFrame:
    """Extension: matched primary keys with incompatible types."""
    return field_matches(compared).filter(F.col("source_pk") & F.col("target_pk") & F.col("type_mismatch")).select(
        *PAIR, "source_field", "target_field", "source_type", "target_type"
    )
