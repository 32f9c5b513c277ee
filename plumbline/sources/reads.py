"""Guarded reads, samples and paged scans of tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.predicates import WRITE_KEYWORDS

ENVELOPE_COLUMN = "attributes"


class WriteBlocked(ValueError):
    """The statement is not a read."""


def read_query(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Result of a read-only statement; ``{name}`` in it stands for a table of ``tables``.

    Columns and row count are those of the DataFrame; the envelope column is dropped.
    """
    text = query.upper().strip()
    if any(text.startswith(k) or f" {k} " in text for k in WRITE_KEYWORDS):
        raise WriteBlocked("Query blocked: only SELECT statements are permitted")
    return without_envelope(spark.sql(query, **(tables or {})))


def without_envelope(df: DataFrame) -> DataFrame:
    return df.drop(ENVELOPE_COLUMN)


def sample_rows(df: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """The first ``size`` rows by ``order``: a repeatable sample."""
    return df.orderBy(*order).limit(size)


def random_sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Extension: a cheap sample without a sort."""
    return df.sample(fraction=fraction, seed=seed)


_COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "starts": lambda c, v: c.startswith(v),
    "is": lambda c, v: {"null": c.isNull(), "known": c.isNotNull()}[v],
}


def record_filter(columns: list[str], conditions: list[tuple]) -> Column:
    """All of ``conditions`` (field, comparison, value); each is of a kind that a scan can take over.

    Fields that do not exist and unknown comparisons are refused. Unknown values fulfil nothing but ``is null``.
    """
    result = F.lit(True)
    for field, comparison, value in conditions:
        if field not in columns:
            raise ValueError(f"no such field: {field}")
        if comparison not in _COMPARISONS or comparison == "is" and value not in ("null", "known"):
            raise ValueError(f"unknown comparison: {comparison} {value if comparison == 'is' else ''}".strip())
        result = result & _COMPARISONS[comparison](F.col(f"`{field}`"), value)
    return result


def filtered_scan(records: DataFrame, conditions: list[tuple], columns: list[str]) -> DataFrame:
    """Extension: the named columns of an entity's records that fulfil all conditions.

    Input partitions take the place of pages; conditions and columns reach the scan.
    """
    for name in columns:
        if name not in records.columns:
            raise ValueError(f"no such field: {name}")
    return records.filter(record_filter(records.columns, conditions)).select(*[F.col(f"`{c}`") for c in columns])


def audit_counts(log: DataFrame, by: list[str]) -> DataFrame:
    """Extension: operations per group of an audit log."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("operation_count"))


def export_audit(log: DataFrame, path: str, fmt: str = "json") -> None:
    """Extension: write an audit log as JSON lines or CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown export format: {fmt}")
    writer = log.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)
