"""Declared column types: base name, compatibility and similarity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base types that can hold each other's values, in either direction.
# The relation is not transitive.
COMPATIBLE_TYPES = [
    ("varchar", "text"),
    ("varchar", "char"),
    ("int", "integer"),
    ("int", "bigint"),
    ("int", "smallint"),
    ("integer", "bigint"),
    ("decimal", "numeric"),
    ("decimal", "float"),
    ("float", "double"),
    ("timestamp", "datetime"),
    ("timestamp", "date"),
    ("boolean", "bit"),
    ("boolean", "tinyint"),
    ("nvarchar", "varchar"),
    ("nvarchar", "text"),
    ("nchar", "char"),
]

# Groups of equivalent type names for the exact-name comparison.
TYPE_GROUPS = [
    ["varchar", "text", "string", "nvarchar", "char"],
    ["int", "integer", "bigint", "smallint", "number"],
    ["float", "double", "decimal", "numeric", "real"],
    ["bool", "boolean", "bit", "tinyint"],
    ["date", "datetime", "timestamp", "datetime2"],
]

SAME_TYPE, SAME_GROUP, UNKNOWN_TYPE, OTHER_TYPE = 1.0, 0.9, 0.5, 0.2


def _stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text, F.lit(" \t\n\v\f\r"))


def type_base(declared: Column) -> Column:
    """``varchar(255)`` -> ``varchar``; text without leading letters is kept whole."""
    stripped = _stripped(declared)
    letters = F.regexp_extract(stripped, "^([A-Za-z]+)", 1)
    return F.lower(F.when(letters != "", letters).otherwise(stripped))


def bases_compatible(a: Column, b: Column) -> Column:
    """Equal base types, or one of the compatible pairs."""
    pairs = ["|".join(sorted(pair)) for pair in COMPATIBLE_TYPES]
    return (a == b) | F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*pairs)


def types_compatible(source: Column, target: Column) -> Column:
    """Compatibility of two declared types, whatever their lengths."""
    return bases_compatible(type_base(F.coalesce(source, F.lit(""))), type_base(F.coalesce(target, F.lit(""))))


def type_similarity(source: Column, target: Column) -> Column:
    """1.0 same text, 0.9 same group, 0.5 when either is empty, else 0.2.

    Lengths are not stripped: ``varchar(10)`` and ``varchar`` score 0.2.
    """
    a, b = F.lower(_stripped(source)), F.lower(_stripped(target))
    same_group = F.lit(False)
    for group in TYPE_GROUPS:
        same_group = same_group | (a.isin(*group) & b.isin(*group))
    either_empty = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "")
    return (
        F.when(either_empty, F.lit(UNKNOWN_TYPE))
        .when(a == b, F.lit(SAME_TYPE))
        .when(same_group, F.lit(SAME_GROUP))
        .otherwise(F.lit(OTHER_TYPE))
    )


def type_key(declared: Column) -> Column:
    """What two types must share to score 1.0; null for an empty type."""
    return F.when(F.coalesce(declared, F.lit("")) != "", F.lower(_stripped(declared)))


def type_group(declared: Column) -> Column:
    """What two types must share to score 0.9 at least: the group's first name, or the type itself; null for an empty type."""
    key = type_key(declared)
    first = F.create_map(*[F.lit(x) for names in TYPE_GROUPS for name in names for x in (name, names[0])])
    # One look-up: a branch per group would work the key out again in each.
    return F.coalesce(F.element_at(first, key), key)


def types_equivalent(source: Column, target: Column) -> Column:
    return type_similarity(source, target) >= SAME_GROUP
