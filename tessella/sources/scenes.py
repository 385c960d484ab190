"""Scene files: sparse models (points, cameras, images) in their binary form, JSON reports of planes, lookups of
sources, and the writing of point files, reports and frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Camera models of the binary format, and how many parameters each has.
CAMERAS = [("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12)]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _chunks(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def read_points(spark: SparkSession, path: str, most_error: float | None = 2.0, least_views: int = 3) -> DataFrame:
    """points3D.bin: point, x, y, z, r, g, b, error, images (of the track); points over the error, or seen by fewer images,
    are skipped while decoding. A file is read by one task, and leaves it in batches."""

    def points(content: bytes):
        n, at = struct.unpack_from("<Q", content)[0], 8
        for _ in range(n):
            row, (views,) = struct.unpack_from("<QdddBBBd", content, at), struct.unpack_from("<Q", content, at + 43)
            if (most_error is None or row[7] <= most_error) and views >= least_views:
                yield (*row, np.frombuffer(content, "<i4", 2 * views, at + 51)[::2].tolist())
            at += 51 + 8 * views

    names = ["point", "x", "y", "z", "r", "g", "b", "error", "images"]

    def run(it):
        for batch in it:
            for content in batch["content"]:
                yield from _chunks(points(content), names)

    return _files(spark, path).mapInPandas(run, "point long, x double, y double, z double, r int, g int, b int, error double, images array<int>")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """cameras.bin: camera, model, width, height, params."""

    def cameras(content: bytes):
        n, at = struct.unpack_from("<Q", content)[0], 8
        for _ in range(n):
            camera, model, width, height = struct.unpack_from("<iiQQ", content, at)
            name, size = CAMERAS[model]
            yield camera, name, width, height, list(struct.unpack_from(f"<{size}d", content, at + 24))
            at += 24 + 8 * size

    def run(it):
        for batch in it:
            for content in batch["content"]:
                yield from _chunks(cameras(content), ["camera", "model", "width", "height", "params"])

    return _files(spark, path).mapInPandas(run, "camera int, model string, width long, height long, params array<double>")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """images.bin in the order of names: image, qw, qx, qy, qz, tx, ty, tz, camera, name, n_points."""

    def images(content: bytes):
        n, at = struct.unpack_from("<Q", content)[0], 8
        for _ in range(n):
            row = struct.unpack_from("<idddddddi", content, at)
            end = content.index(b"\0", at + 64)
            (points,) = struct.unpack_from("<Q", content, end + 1)
            yield (*row, content[at + 64 : end].decode(), points)
            at = end + 9 + 24 * points

    names = ["image", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera", "name", "n_points"]

    def run(it):
        for batch in it:
            for content in batch["content"]:
                yield from _chunks(images(content), names)

    return _files(spark, path).mapInPandas(run, "image int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera int, name string, n_points long").orderBy("name")


def read_planes(spark: SparkSession, path: str, schema: StructType | str, field: str = "proxies") -> DataFrame:
    """The entries of an array in a JSON report, a row each."""
    x = spark.read.option("multiLine", True).schema(f"`{field}` array<struct<{schema}>>" if isinstance(schema, str) else schema).json(path)
    return x.select(F.explode(field).alias("_e")).select("_e.*")


def first_existing(wanted: DataFrame, there: DataFrame, name: str, candidates: list[Column]) -> DataFrame:
    """wanted with path: the first of its candidate paths that is in there (path); null if none is."""
    options = F.posexplode(F.array(*candidates))
    x = wanted.select(name, options.alias("_k", "path")).join(there.select("path").distinct(), "path")
    best = x.groupBy(name).agg(F.min(F.struct("_k", "path")).alias("_b")).select(name, F.col("_b.path").alias("path"))
    return wanted.join(best, name, "left")


def guide_paths(images: DataFrame, scans: DataFrame, guides: DataFrame) -> DataFrame:
    """images (name) by way of scans (name, scan, frame) to guides (scan, frame, path); an image without a guide is an
    error that names one of them."""
    x = images.join(scans, "name", "left").join(guides, ["scan", "frame"], "left")
    lost = x.filter("path is null").select("name").first()
    if lost:
        raise ValueError(f"no guide for {lost.name}")
    return x.select("name", "scan", "frame", "path")


def write_json(df: DataFrame, path: str) -> None:
    """A small report as one JSON file in a folder, keys in the order of the columns."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_frames(df: DataFrame, path: str, frame: str = "frame") -> None:
    """One folder of Parquet for each frame, rows of a frame together."""
    df.repartition(frame).write.mode("overwrite").partitionBy(frame).parquet(path)


def write_ply(df: DataFrame, path: str, row: str, columns: list[str]) -> None:
    """One ASCII PLY file in a folder: the rows in the order of their ids, each column a float property. It is for
    exchange: one task writes the file, a row at a time."""
    n = df.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in columns], "end_header"]
    top = df.sparkSession.createDataFrame([(k, h) for k, h in enumerate(head)], "_k long, value string").select(F.lit(0).alias("_part"), "_k", "value")
    body = df.select(F.lit(1).alias("_part"), F.col(row).cast("long").alias("_k"), F.concat_ws(" ", *[F.col(c).cast("float").cast("string") for c in columns]).alias("value"))
    top.unionByName(body).repartition(1).sortWithinPartitions("_part", "_k").select("value").write.mode("overwrite").text(path)


def merge_tables(parts: list[DataFrame], row: str) -> DataFrame:
    """The tables of several writers as one, told by part, with rows numbered on from part to part."""
    out, base = None, 0
    for k, p in enumerate(parts):
        x = p.withColumn("part", F.lit(k)).withColumn(row, F.col(row) + base)
        base += p.count()
        out = x if out is None else out.unionByName(x)
    return out
