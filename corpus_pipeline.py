"""Documents through quality rules, near-dedup, substring dedup, decontamination and sampled tokenisation.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, neardup, pieces, quality, substrings
from tessella.llm.common import stage
from tessella.llm.queries import model_file, table


#: Rows that cross to Python at once: texts are long, and several copies of a batch are held there.
BATCH = "1000"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return neardup.keep(docs, size=5, percent=80)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return substrings.remove(docs, window=50)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), window=10, longest=10, coverage=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return pieces.encode(docs, model_file(spark), k=2)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_substrings),
    ("decontamination", benchmark_spans),
    ("sentencepiece", tokens),
]

#: SQL can't express the sampled tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"stage-{k}")
    return docs
