"""Documents to packed training sequences in five stages, each one operator of rillwork.llm.

Every stage works on all that its predecessor kept, and is written as Parquet before the next one reads it: a lost
executor costs a stage's own work at most. The first four return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import near_copies, op1_quality, op2_packing, op5_decontaminate, op10_lines
from rillwork.llm.common import materialise, read


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and the lines above the limits from those that stay. Texts without 50 words are rejected, so null and empty ones are; of repeated rows all stay."""
    return _counted(op1_quality.apply_rules(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first stays. Documents stay, if empty; a null text stays null. Rows equal in id and text keep the same lines."""
    return _counted(op10_lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar to 0.8 or more, one stays: that of the least id; null ids come last. Texts without words are copies of each other.
    Candidates are the links of op7's fingerprints by BK-trees, which the shingles verify, and what min-hashes find beyond two bits."""
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Null and empty texts stay, and all do if the benchmark is empty."""
    return op5_decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its bin, place and length. A null or empty text is the end token alone; a long one has several pieces; repeated rows are packed each."""
    return op2_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express edit similarity groups, fingerprints or packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
