"""Text and number formatting with Python's conventions, as native expressions."""

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Text of ``value`` with ``digits`` decimals, half-even on the exact binary value.

    ``round``/``bround`` work on the shortest decimal text and differ on ties, so the
    text of ``format_number`` is used, without its thousands separators.
    """
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def rounded(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals, half-even on the exact binary value."""
    return fixed(value, digits).cast("double")


def percent(value: Column, digits: int = 1) -> Column:
    """Text of a 0..1 share as a percentage."""
    return F.concat(fixed(value * F.lit(100.0), digits), F.lit("%"))


def truncated(value: Column, length: int) -> Column:
    """First ``length`` characters (code points)."""
    return F.substring(value, 1, length)


def spaced(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def titled(value: Column) -> Column:
    """``rest_api`` -> ``Rest Api``."""
    return F.initcap(spaced(value))


def fallback(value: Column, domain: list[str], default: str) -> Column:
    """``value`` when it belongs to ``domain``, otherwise ``default`` (also for null)."""
    return F.when(value.isin(*domain), value).otherwise(F.lit(default))


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by the text of the column given for it."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)
