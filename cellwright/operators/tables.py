"""Column-wise and table-wise building blocks with the semantics of the notebooks' dataframes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.runtime import cut, parts


def case_last_wins(rules: list[tuple[Column, object]], default: Column) -> Column:
    """Rules in the order in which they overwrite each other: the last that holds decides."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), rules, default)


def quantile_bin(value: Column, edges: Column, n_edges: int) -> Column:
    """Index of the interval (a, b] between consecutive ``edges``; null at or below the first and above the last."""
    at = lambda i: F.element_at(edges, i + 1)
    return F.coalesce(*(F.when((value > at(i)) & (value <= at(i + 1)), F.lit(i)) for i in range(n_edges - 1)))


def first_per(df: DataFrame, key: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def cumulative(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, value, __n, __upto): rows per distinct value, and rows of the group up to it, for any number of distinct values.

    Distinct values are range-partitioned; running sums are taken inside each range and start from the sums of the ranges before.
    """
    sizes = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    ranged = cut(sizes.repartitionByRange(parts(df.sparkSession), *group, value).withColumn("__p", F.spark_partition_id()))
    inside = F.sum("__n").over(Window.partitionBy(*group, "__p").orderBy(value))
    block = ranged.groupBy(*group, "__p").agg(F.sum("__n").alias("__b"))
    before = block.withColumn("__before", F.sum("__b").over(Window.partitionBy(*group).orderBy("__p")) - F.col("__b")).drop("__b")  # one row per range
    return ranged.withColumn("__in", inside).join(before, [*group, "__p"]).select(*group, value, "__n", (F.col("__in") + F.col("__before")).alias("__upto"))


def average_rank(df: DataFrame, value: str, group: list[str], out: str) -> DataFrame:
    """Ranks with the mean rank for ties, from counts per value: neither rows nor distinct values of a group meet in one task."""
    ranks = cumulative(df, value, group).withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2)
    return df.join(ranks.drop("__n", "__upto"), [*group, value])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str]) -> DataFrame:
    """(group, one column per share): exact quantiles, interpolated between neighbours; nulls don't count."""
    if not group:
        return quantiles(df.withColumn("__one", F.lit(1)), value, shares, ["__one"]).drop("__one")
    c = cumulative(df.where(F.col(value).isNotNull()), value, group)
    c = c.join(c.groupBy(*group).agg(F.sum("__n").alias("__all")), group)
    at = {name: (F.col("__all") - 1) * p for name, p in shares.items()}
    holds = lambda h: (F.col("__upto") - F.col("__n") <= h) & (h < F.col("__upto"))
    ends = [F.max(F.when(holds(f(h)), F.col(value))).alias(f"{name}__{k}") for name, h in at.items() for k, f in (("low", F.floor), ("high", F.ceil))]
    found = c.groupBy(*group, "__all").agg(*ends)
    return found.select(*group, *((F.col(f"{n}__low") + (F.col(f"{n}__high") - F.col(f"{n}__low")) * (h - F.floor(h))).alias(n) for n, h in at.items()))


def union_common(*tables: DataFrame) -> DataFrame:
    """UNION ALL over the columns that all tables share."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, (t.select(*shared) for t in tables))


def argmax_partner(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, ties to the smaller; nulls don't count."""
    n = df.dropna(subset=[key, value]).groupBy(key, value).agg(F.count("*").alias("n"))
    return first_per(n, [key], F.desc("n"), value)


def literal_list(text: Column) -> Column:
    """A list literal of strings ("['a', 'b']") as an array; null for text without brackets, empty for an empty list."""
    inner = F.regexp_extract(text, r"(?s)^\s*\[(.*)\]\s*$", 1)
    items = F.regexp_extract_all(inner, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.transform(items, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))
