"""The corpus pipeline: five stages, each on all that its predecessor kept, from documents to packed sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of documents.

Edge cases: a null or empty text has the classifier's bias for a score and passes if that does; it has no lines,
shingles or windows, so the next stages leave it alone, and packing gives it the end token.  Rows that repeat a doc_id are
one document to the stages that compare documents, and stay or go together.  Without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewise.llm import decontam, lines, neardup, packing, quality
from clausewise.llm.common import documents, materialize, table, work_tables
from clausewise.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first."""
    return lines.drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays."""
    return neardup.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]

#: Trained vectors, approximate candidates and a tokenizer have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages lies a written table in the shared folder, and a stage's own work tables go with it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with work_tables(spark, keep=1):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
