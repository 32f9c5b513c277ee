"""Field names: normal form, key-like tests and string similarity."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_field_name(name: Column) -> Column:
    """snake_case form: ``FirstName`` -> ``first_name``, ``KUNNR`` -> ``k_u_n_n_r``."""
    snake = F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))
    words = F.regexp_replace(snake, "[^a-z0-9]+", "_")
    return F.trim(F.regexp_replace(words, "_+", "_"), F.lit("_"))


def looks_like_id(name: Column) -> Column:
    """Substring test, so ``paid`` and ``width`` count too."""
    return F.contains(F.lower(name), F.lit("id"))


def is_identifier(name: str) -> bool:
    """Column names whose values are checked for duplicates."""
    return "id" in name.lower() and "foreign" not in name.lower()


def is_key(name: str) -> bool:
    """Column names whose nulls are critical."""
    return "id" in name.lower() or "key" in name.lower()


def within_length_ratio(a: Column, b: Column) -> Column:
    """False when either text is empty or one is more than three times as long."""
    la, lb = F.length(a), F.length(b)
    return (F.least(la, lb) > 0) & (F.greatest(la, lb) <= F.least(la, lb) * 3)


def character_mask(name: Column) -> Column:
    """64-bit mask of a normalised name's characters, repeats marked apart.

    First occurrences of a-z, 0-9 and ``_`` have bits 0-36 of their own; further
    occurrences share the bits above.
    """
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789_"
    chars = F.filter(F.split(name, ""), lambda c: c != "")

    def bit(ch: Column, at: Column) -> Column:
        occurrence = F.size(F.filter(F.slice(chars, 1, at + 1), lambda c: c == ch))
        first = F.instr(F.lit(alphabet), ch) - 1
        repeat = F.lit(37) + F.pmod(F.xxhash64(ch, occurrence), F.lit(27))
        place = F.when(occurrence == 1, first).otherwise(repeat).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return F.aggregate(F.transform(chars, bit), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(c))


def most_shared(mask_a: Column, length_a: Column, mask_b: Column, length_b: Column) -> Column:
    """Upper bound of the number of characters two names share, from their masks."""
    only_a = F.bit_count(mask_a.bitwiseAND(F.bitwise_not(mask_b)))
    only_b = F.bit_count(mask_b.bitwiseAND(F.bitwise_not(mask_a)))
    return F.least(length_a - only_a, length_b - only_b)


def matching_ratio(source: Column, target: Column) -> Column:
    """Ratcliff-Obershelp ratio of two normalised names.

    The ratio depends on the argument order; it is always taken as (source, target).
    A Python function over Arrow batches; callers pass distinct pairs only.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        sources, targets = a.tolist(), b.tolist()
        scores = [0.0] * len(sources)
        matcher = SequenceMatcher(None, "", "", autojunk=False)
        current = None
        # The matcher indexes its second text, so visit equal targets one after another.
        for row in sorted(range(len(targets)), key=targets.__getitem__):
            if targets[row] != current:
                current = targets[row]
                matcher.set_seq2(current)
            matcher.set_seq1(sources[row])
            scores[row] = matcher.ratio()
        return pd.Series(scores, index=a.index)

    return ratio(source, target)


def field_similarity(source: Column, target: Column) -> Column:
    """Similarity of two raw field names in 0..1; meant for distinct pairs."""
    a, b = normalize_field_name(source), normalize_field_name(target)
    return (
        F.when(a == b, F.lit(1.0))
        .when(~within_length_ratio(a, b), F.lit(0.0))
        .otherwise(matching_ratio(a, b))
    )
