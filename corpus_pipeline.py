"""Corpus pipeline: from raw documents to packed training sequences.

Quality rules drop whole documents; line dedup removes the later copies of repeated passages, and documents of which
nothing is left; near-dedup keeps one document of each class; packing cuts what remains into pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, near_dedup, packing, quality_rules
from plumbline.llm.bpe import FEW_WORDS
from plumbline.llm.common import table, written


REST = "pipeline_rest"


def _bundled(docs: DataFrame) -> DataFrame:
    """(doc_id, text, pipeline_rest): all other columns in one, so that a stage's own columns clash with none of them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias(REST), *rest).alias(REST))


def _unbundled(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **changed}
    return rows.select(*[own.get(c, F.col(f"{REST}.`{c}`")).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps, unchanged."""
    return _unbundled(quality_rules.apply_policy(quality_rules.ledger(_bundled(docs))), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated passages, ``n_chars`` to match; documents that lost every line go."""
    rows = line_dedup.dedup(_bundled(docs)).filter("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" not in docs.columns:
        return _unbundled(rows, docs.columns)
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(f"{REST}.n_chars"))
    return _unbundled(rows, docs.columns, n_chars=size)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near duplicates, unchanged."""
    return near_dedup.first_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    # Workers of the stages before are still there, so those of this one remember fewer words.
    return packing.pack(written(packing.cut(docs, most_words=FEW_WORDS), "pipeline-pieces"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("packing", pack_sequences),
]

# Signatures, tokens and packing have no SQL; tests compare run() with plain versions of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
