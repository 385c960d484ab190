"""Scans, sinks and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def required(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def latest_step(files: DataFrame, pattern: str = r"(\d+)\D*$") -> DataFrame:
    """The file of the largest step in its name."""
    step = F.coalesce(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long"), F.lit(-1))
    return files.agg(F.max_by("path", F.struct(step, "path")).alias("path"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(path)
