"""Top-k, sampling, deduplication and rewriting of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.windows import numbered


def top_k(df: DataFrame, x: str, row: str, k: int) -> DataFrame:
    """The k largest positive values, ties to the lowest id."""
    return df.filter((F.col(x) > 0) & ~F.isnan(x)).orderBy(F.desc(x), row).limit(k)


def top_k_by(df: DataFrame, keys: list[str], x: str, row: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(x), row)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def every(df: DataFrame, row: str, stride: int, most: int) -> DataFrame:
    """Every stride-th row by a dense id, then the first of them."""
    return df.filter(F.col(row) % stride == 0).orderBy(row).limit(most)


def groups(df: DataFrame, row: str, n: int, least: int) -> DataFrame:
    """Interleaved groups of ids, small groups left out."""
    g = df.withColumn("part", F.col(row) % n)
    return g.join(g.groupBy("part").count().filter(F.col("count") >= least).select("part"), "part")


def without_parents(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    return children.join(parents, children[fk] == parents[pk], "left_anti")


def compact(df: DataFrame, row: str, used: DataFrame, key: str) -> DataFrame:
    """Rows that are referred to, with dense new ids in the order of the old."""
    keep = df.join(used.select(F.col(key).alias(row)).distinct(), row, "left_semi")
    return numbered(keep, [row], "new_id")


def distinct_sets(df: DataFrame, members: list[str], row: str) -> DataFrame:
    """One row, the first, for each set of members, whatever their order."""
    return df.groupBy(F.array_sort(F.array(*members)).alias("members")).agg(F.min(row).alias(row))


def split_rows(df: DataFrame, when: Column, x: str, by: float) -> DataFrame:
    """Rows for which it holds are replaced by two with x divided."""
    two = df.filter(when).withColumn("child", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(x, F.col(x) / by)
    return df.filter(~when).withColumn("child", F.lit(None).cast("int")).unionByName(two)


def overlay(df: DataFrame, cell: list[str], priority: str, row: str) -> DataFrame:
    """Each cell goes to the record of highest priority; ties to the lowest id."""
    return df.groupBy(*cell).agg(F.max_by(row, F.struct(priority, F.negative(row))).alias("owner"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that holds on a row."""
    return df.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))))


def first_reason(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, c in reversed(rules):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def uniform(row: str, seed: int) -> Column:
    """A number between 0 and 1 from the id and the seed, the same in every run."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row).cast("string")).cast("binary"))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def weighted_sample(df: DataFrame, row: str, weight: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, each draw in proportion to the weights of what is left: the k smallest waiting
    times. Rows of no weight are never drawn."""
    wait = -F.log(uniform(row, seed)) / F.col(weight)
    return df.filter(F.col(weight) > 0).withColumn("_wait", wait).orderBy("_wait", row).limit(k).drop("_wait")


def without_lowest(df: DataFrame, x: str, row: str, n: int) -> DataFrame:
    """All rows but the n of lowest value, ties to the lowest id. Only n ids are sorted."""
    low = df.orderBy(x, row).limit(n).select(row)
    return df.join(low, row, "left_anti")


def replay(labels: DataFrame, edits: DataFrame, row: str) -> DataFrame:
    """labels (row, label) after edits (step, row, label): the last edit of a row wins; rows without one stay."""
    last = edits.groupBy(row).agg(F.max_by("label", "step").alias("_new"))
    return labels.join(last, row, "left").select(row, F.coalesce("_new", "label").alias("label"))
