"""Filters over molecules and cells."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name prefixes of control probes.
CONTROLS = ("NegControlProbe_", "antisense_", "NegControlCodeword_", "BLANK_", "DeprecatedCodeword_", "UnassignedCodeword_")


def text(df: DataFrame, name: str) -> Column:
    """The column as string; bytes are read as UTF-8."""
    return F.decode(F.col(name), "UTF-8") if dict(df.dtypes)[name] == "binary" else F.col(name)


def filter_transcripts(df: DataFrame, min_qv: float = 30.0, name: str = "feature_name", qv: str = "qv", prefixes=CONTROLS) -> DataFrame:
    """Rows of at least ``min_qv`` whose name starts with none of ``prefixes``; null in either drops the row.

    Written as an or of ``startswith``, which reaches the Parquet scan; a pattern would not.
    """
    control = reduce(or_, (text(df, name).startswith(p) for p in prefixes))
    return df.where((F.col(qv) >= min_qv) & ~F.isnan(qv) & ~control)


def filter_containing(df: DataFrame, name: str, substrings, qv: str, min_qv: float) -> DataFrame:
    """Rows of at least ``min_qv`` whose name contains none of ``substrings``."""
    hit = reduce(or_, (F.contains(text(df, name), F.lit(s)) for s in substrings))
    return df.where((F.col(qv) >= min_qv) & ~F.isnan(qv) & ~hit)


def filter_total(m: DataFrame, key: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows of the count matrix (cell, gene, n) whose total per ``key`` lies in least..most."""
    total = F.sum("n")
    kept = m.groupBy(key).agg(total.alias("t")).where((F.col("t") >= least) & (F.lit(True) if most is None else F.col("t") <= most))
    return m.join(kept, key, "left_semi")


def filter_group(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows of the groups whose aggregate ``condition`` holds."""
    return df.join(df.groupBy(key).agg(condition.alias("ok")).where("ok"), key, "left_semi")
