"""Tables written to the folder that driver and executors share, and read back: they cut lineage and survive lost
executors. Unlike a checkpoint, a table that is read back has the size that was measured when it was written, so the
sizes that the optimiser multiplies at each join do not grow from round to round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary one, and any
    other an error: no folder of one machine would do."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def stage(df: DataFrame, label: str = "table", codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back; Spark may delete the shuffle files that led to it. The files go
    when the driver's JVM ends, or with unstage()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}/{label}"
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged, out._path = jpath, path
    return out


def stage_by(df: DataFrame, key: str | list[str], n: int, label: str = "table", codec: str = "zstd", order: str | None = None) -> DataFrame:
    """Like stage(), in n buckets of key, one column or several (100,000 at most, as Spark allows): grouping the table by
    key, or grouping or joining it with another one in as many buckets, does not shuffle it again. Buckets are sorted by
    `order`, so that a filter on it skips most of a file. The catalog forgets the table's name at once."""
    spark = df.sparkSession
    path, name = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}/{label}", f"tessella_{uuid.uuid4().hex}"
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.format("parquet").option("compression", codec).option("path", path).bucketBy(min(n, 100_000), key)
        (out.sortBy(order) if order else out).saveAsTable(name)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay: it was given a path
    out._staged, out._path = jpath, path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later job reads."""
    for t in tables:
        t._staged.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(t._staged, True)


def reread(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one scan, however many they are."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t._path for t in tables])
