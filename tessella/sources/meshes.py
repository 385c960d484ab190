"""Mesh and array files as tables: OBJ, PLY, NPZ. A file is one task's work; what a task reads at once is one file."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: PLY's names of number types.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
VERTICES = "path string, vertex_id long, x double, y double, z double"
FACES = "path string, face_id long, corners array<long>"


def _numbered(df: DataFrame) -> DataFrame:
    """Lines of each file with their place in it."""
    return df.select(F.col("path"), F.posexplode(F.split(F.decode("content", "utf-8"), "\r?\n")).alias("line_no", "line"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OBJ files; corners count from 0, negative ones from the vertices before the face."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = _numbered(_files(spark, path)).select("path", "line_no", parts.alias("p")).filter(F.col("p")[0].isin("v", "f"))
    # numbers of a file's lines need its lines in order, so each file is counted as one array
    each = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "p"))).alias("rows"))
    own = lambda kind: F.filter("rows", lambda r: r["p"][0] == kind)
    v = each.select("path", F.posexplode(own("v")).alias("vertex_id", "r"))
    v = v.select("path", F.col("vertex_id").cast("long"), *[F.col("r.p")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")])
    before = each.select("path", F.transform(own("v"), lambda r: r["line_no"]).alias("at"), F.posexplode(own("f")).alias("face_id", "r"))
    n = F.size(F.filter("at", lambda a: a < F.col("r.line_no")))
    corner = lambda c: F.split(c, "/")[0].cast("long")
    corners = F.transform(F.slice("r.p", F.lit(2), F.size("r.p") - 1), lambda c: F.when(corner(c) < 0, corner(c) + n).otherwise(corner(c) - 1))
    return v, before.select("path", F.col("face_id").cast("long"), corners.alias("corners"))


def parse_ply(content: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    """Vertex columns and faces of an ASCII or binary PLY file; other elements are read over."""
    end = content.index(b"end_header")
    body = content.index(b"\n", end) + 1
    elements: list[tuple[str, int, list[list[str]]]] = []
    order = "ascii"
    for words in (line.split() for line in content[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            order = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    sign = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[order]
    tokens = iter(content[body:].split()) if order == "ascii" else None
    at, vertices, faces = body, {}, []

    def number(kind: str):
        nonlocal at
        if tokens is not None:
            x = next(tokens)
            return float(x) if PLY_TYPES[kind][0] == "f" else int(x)
        t = np.dtype(sign + PLY_TYPES[kind])
        x = np.frombuffer(content, t, 1, at)[0].item()
        at += t.itemsize
        return x

    for name, count, fields in elements:
        if tokens is None and all(f[0] != "list" for f in fields):
            t = np.dtype([(f[-1], sign + PLY_TYPES[f[0]]) for f in fields])
            got = np.frombuffer(content, t, count, at)
            at += t.itemsize * count
            columns = {f[-1]: got[f[-1]] for f in fields}
        else:
            lists: dict[str, list] = {f[-1]: [] for f in fields}
            for _ in range(count):
                for f in fields:
                    lists[f[-1]].append([number(f[2]) for _ in range(int(number(f[1])))] if f[0] == "list" else number(f[0]))
            columns = lists
            if name == "face":
                faces = next((lists[n] for n in ("vertex_indices", "vertex_index") if n in lists), [])
        if name == "vertex":
            vertices = {k: np.asarray(v, float) for k, v in columns.items()}
    return vertices, faces


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of PLY files."""

    def vertices(it):
        for batch in it:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                v, _ = parse_ply(content)
                yield pd.DataFrame({"path": p, "vertex_id": np.arange(len(v["x"])), "x": v["x"], "y": v["y"], "z": v["z"]})

    def faces(it):
        for batch in it:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                f = parse_ply(content)[1]
                yield pd.DataFrame({"path": [p] * len(f), "face_id": np.arange(len(f)), "corners": f})

    files = _files(spark, path).select("path", "content")
    return files.mapInPandas(vertices, VERTICES), files.mapInPandas(faces, FACES)


def read_npz(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """path, row and the named arrays (name to SQL type) of NPZ files, a row for each first index. Arrays of a file
    must be as long as each other; a missing name fails."""
    schema = ", ".join(["path string", "row long", *[f"`{n}` {t}" for n, t in columns.items()]])

    def rows(it):
        for batch in it:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    missing = sorted(set(columns) - set(z.files))
                    if missing:
                        raise ValueError(f"{p}: missing arrays: {', '.join(missing)}")
                    got = {n: z[n] for n in columns}
                sizes = {len(a) for a in got.values()}
                if len(sizes) > 1:
                    raise ValueError(f"{p}: arrays of different lengths: {sorted(sizes)}")
                flat = {n: a if a.ndim == 1 else [x.ravel() for x in a] for n, a in got.items()}
                yield pd.DataFrame({"path": p, "row": np.arange(next(iter(sizes), 0)), **flat})

    return _files(spark, path).select("path", "content").mapInPandas(rows, schema)
