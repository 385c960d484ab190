"""Streaming forms of the running state: sums, counts and maxima by key, whole or by window of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _state(sums: list[str], largest: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.max(c).alias(f"max_{c}") for c in largest]]


def running(df: DataFrame, keys: list[str], sums: list[str], largest: list[str]) -> DataFrame:
    """keys, n, sum_*, max_* so far; write it in update or complete mode. Null keys are a key of their own."""
    return df.groupBy(*keys).agg(*_state(sums, largest))


def windowed(df: DataFrame, keys: list[str], sums: list[str], largest: list[str], ts: str, width: str, late: str) -> DataFrame:
    """The same for each window of event time; rows later than `late` are left out, which bounds the state kept."""
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*_state(sums, largest))
    return w.select(F.col("window.start").alias("start"), *keys, "n", *[f"sum_{c}" for c in sums], *[f"max_{c}" for c in largest])
