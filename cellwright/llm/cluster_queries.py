"""Problem 5: patches of cells of one phenograph cluster that lie together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.similarity_clusters import describe_clusters, similarity_clusters
from cellwright.llm.vector_queries import USABLE_SQL, usable_cells

RADIUS_UM, LEAST_CELLS = 20.0, 10


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = usable_cells(spark, sf_dir).where("phenograph_cluster >= 0")
    members, _ = similarity_clusters(cells, "obs_id", "X_spatial", ["dataset", "h5ad_name", "phenograph_cluster"], 2, radius=RADIUS_UM)
    return members.where(F.col("size") >= LEAST_CELLS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir).select(F.col("cluster").alias("patch_id"), F.col("id").alias("obs_id"))


def p5_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch with its cells, the communities that it unites and its most typical cells."""
    return describe_clusters(_patches(spark, sf_dir)).withColumnRenamed("cluster", "patch_id")


QUERIES = {"p5_found": p5_found, "p5_patches": p5_patches}
ORACLES = {
    "p5_found": f"""WITH RECURSIVE c AS (SELECT DISTINCT obs_id AS id, dataset, h5ad_name, phenograph_cluster AS pc, X_spatial[1] AS x, X_spatial[2] AS y
  FROM h5ads WHERE phenograph_cluster >= 0 AND {USABLE_SQL}),
e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.dataset = b.dataset AND a.h5ad_name = b.h5ad_name AND a.pc = b.pc
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS_UM} * {RADIUS_UM}),
r AS (SELECT id, id AS seen FROM c UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.seen),
p AS (SELECT id, min(seen) AS patch, count(*) AS n FROM r GROUP BY id)
SELECT patch AS patch_id, id AS obs_id FROM p WHERE n >= {LEAST_CELLS}"""
}
