"""Corpus pipeline: from raw documents to the words that a training mix takes.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of their
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekcast.llm import decontam, line_runs, mixing, quality, simhash
from weekcast.llm.queries import QUERIES  # noqa: F401 - registers the modules for shipping
from weekcast.sources.sinks import materialize
from weekcast.sources.tables import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail a base rule, or a rule their host is guilty of, go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later copies of repeated line runs are deleted from the texts."""
    return line_runs.remove_repeated_runs(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each component of linked fingerprints stays (shingle length
    and bit distance of ``op1_simhash``)."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that contain a benchmark item go."""
    return decontam.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: words that the mix takes of each remaining document."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup),
          ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources)]

#: XXH64 of shingles has no DuckDB equivalent: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
