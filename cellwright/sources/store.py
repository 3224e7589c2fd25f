"""Storage formats: the matrix store (a directory of Parquet tables), CSV, and polygons as well-known binary."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_matrix(path: str, **tables: DataFrame) -> None:
    """An annotated matrix as one folder: counts, cells, genes, embeddings, edges - whichever are given."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_matrix(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def first_match(spark: SparkSession, pattern: str) -> str:
    """The first path, in the order of names, that a glob pattern matches; an error if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(pattern)
    return min(f.getPath().toString() for f in found)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str, positions: list[int] | None = None) -> DataFrame:
    """CSV with a given schema (nothing is inferred), columns picked by position if asked."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df if positions is None else df.select(*(df.columns[i] for i in positions))


@F.pandas_udf(T.BinaryType())
def to_wkb(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Closed rings as WKB polygons (little endian)."""
    def one(x, y):
        if x is None or len(x) < 3:
            return None
        pts = list(zip(x, y))
        pts += [pts[0]] if tuple(pts[0]) != tuple(pts[-1]) else []
        return struct.pack("<BIII", 1, 3, 1, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)

    return pd.Series([one(x, y) for x, y in zip(xs, ys)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def from_wkb(blobs: pd.Series) -> pd.Series:
    """The outer ring of a WKB polygon, or of the first polygon of a multipolygon, as [x, y] pairs; null if it is neither."""
    def one(b):
        if b is None or len(b) < 13:
            return None
        e = "<" if b[0] == 1 else ">"
        kind, at = struct.unpack_from(f"{e}I", b, 1)[0] % 1000, 5
        if kind == 6:
            return one(bytes(b[9:]))
        if kind != 3 or struct.unpack_from(f"{e}I", b, at)[0] < 1:
            return None
        n = struct.unpack_from(f"{e}I", b, at + 4)[0]
        return [list(struct.unpack_from(f"{e}dd", b, at + 8 + 16 * i)) for i in range(n)]

    return pd.Series([one(b) for b in blobs])
