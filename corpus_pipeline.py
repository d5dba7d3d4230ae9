"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of documents. Defined for null, empty and very long
texts (always whole), ties, repeated rows and extra columns (whatever their names) as the
operators are; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.common import boxed, discard, materialize, table
from priorframe.llm.decontaminate import contaminated, mark_contamination
from priorframe.llm.line_dedup import drop_duplicate_lines
from priorframe.llm.mixing import mix_documents
from priorframe.llm.near_dup import keep_one_of_each
from priorframe.llm.quality_rules import keep_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go."""
    return keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of equal or similar lines one stays; documents left without words go."""
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    marked = mark_contamination(boxed(docs, F.col("text")), table(spark, sf_dir, "benchmark"))
    return marked.filter(~contaminated()).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with mix_copies: how often."""
    return mix_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
]

#: Signatures and balanced sampling can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one's is written, but for the last, which the result reads."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            if kept is not None:
                discard(kept)
            kept = docs
    return docs
