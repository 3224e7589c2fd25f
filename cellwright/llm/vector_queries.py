"""Problem 1: the cells of each exported object that are nearest to each other by X_spatial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.similar_vectors import similar_vectors
from cellwright.operators.knn import vector_search
from cellwright.runtime import cut, table

NEIGHBOURS = 5


def usable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of h5ads whose X_spatial is two finite numbers, neither negative (placeholders are)."""
    return table(spark, sf_dir, "h5ads").where(F.coalesce(F.forall("X_spatial", lambda x: x >= 0), F.lit(False)))


GROUP = ["dataset", "h5ad_name"]


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(usable_cells(spark, sf_dir), "obs_id", "X_spatial", GROUP, 2, NEIGHBOURS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select(F.least("id", "neighbour").alias("obs_id_a"), F.greatest("id", "neighbour").alias("obs_id_b")).distinct()


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group, for the cells whose id is divisible by 50: how many, and whether at least 0.95 of their exact neighbours are found."""
    v = usable_cells(spark, sf_dir).where(F.size("X_spatial") == 2).where(F.forall("X_spatial", lambda x: x < float("inf")))
    v = cut(v.select("obs_id", *GROUP, "X_spatial").dropna().dropDuplicates(["obs_id"]))
    exact = vector_search(v.select(F.col("obs_id").alias("id"), F.xxhash64(*GROUP).alias("g"), F.col("X_spatial").alias("v")), v.where("obs_id % 50 = 0").select(F.col("obs_id").alias("qid"), F.xxhash64(*GROUP).alias("g"), F.col("X_spatial").alias("q")), NEIGHBOURS, group="g", skip_self=True)
    got = _near(spark, sf_dir).select(F.col("id").alias("qid"), F.col("neighbour").alias("id"), F.lit(1).alias("hit"))
    per = exact.select("qid", "id").join(got, ["qid", "id"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))
    return per.select("pairs", (F.col("hits") >= 0.95 * F.col("pairs")).alias("enough"))


USABLE_SQL = "len(X_spatial) = 2 AND NOT isnan(X_spatial[1]) AND NOT isnan(X_spatial[2]) AND X_spatial[1] >= 0 AND X_spatial[1] < 'inf'::DOUBLE AND X_spatial[2] >= 0 AND X_spatial[2] < 'inf'::DOUBLE"
QUERIES = {"p1_found": p1_found, "p1_recall": p1_recall}
#: p1_found is approximate, so its check is the measured recall.
ORACLES = {
    "p1_recall": f"""WITH c AS (SELECT DISTINCT obs_id AS id, dataset, h5ad_name FROM h5ads WHERE {USABLE_SQL}),
n AS (SELECT *, count(*) OVER (PARTITION BY dataset, h5ad_name) AS n FROM c) SELECT sum(least({NEIGHBOURS}, n - 1))::BIGINT AS pairs, true AS enough FROM n WHERE id % 50 = 0"""
}
