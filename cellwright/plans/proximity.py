"""Problem 4: for every molecule, the cells that contain it and the molecules right beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators.proximity import nearby
from cellwright.runtime import table

RADIUS_UM = 0.2


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearby(
        table(spark, sf_dir, "labeled_transcripts"),
        table(spark, sf_dir, "cell_boundaries"),
        RADIUS_UM,
        id_col="transcript_id", frame="dataset", x="x_location", y="y_location",
        region="cell_id", order="vertex_no", vx="vertex_x", vy="vertex_y",
    )
    return out.select("kind", F.col("id").alias("transcript_id"), F.col("match").alias("match_key"))


_OK = "NOT isnan({0}) AND {0} >= 0 AND {0} < 'inf'::DOUBLE"
_SQL = f"""WITH p AS (SELECT DISTINCT transcript_id AS id, dataset, x_location AS x, y_location AS y FROM labeled_transcripts
  WHERE transcript_id IS NOT NULL AND {_OK.format("x_location")} AND {_OK.format("y_location")}),
g AS (SELECT *, CAST(floor(x) AS BIGINT) AS gx, CAST(floor(y) AS BIGINT) AS gy FROM p),
o AS (SELECT a.x AS dx, b.y AS dy FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y)),
near AS (SELECT a.id, b.id AS other FROM (SELECT g.*, gx + dx AS hx, gy + dy AS hy FROM g, o) a JOIN g b ON b.dataset = a.dataset AND b.gx = a.hx AND b.gy = a.hy
  WHERE a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS_UM}::DOUBLE * {RADIUS_UM}::DOUBLE),
v AS (SELECT DISTINCT dataset, cell_id, vertex_no, vertex_x AS x, vertex_y AS y FROM cell_boundaries
  WHERE cell_id IS NOT NULL AND vertex_no IS NOT NULL AND vertex_x IS NOT NULL AND vertex_y IS NOT NULL AND NOT isnan(vertex_x) AND NOT isnan(vertex_y)),
c AS (SELECT dataset, cell_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY ALL HAVING count(DISTINCT (x, y)) >= 3),
e AS (SELECT dataset, cell_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first(x) OVER w) AS bx, coalesce(lead(y) OVER w, first(y) OVER w) AS byy
  FROM v WINDOW w AS (PARTITION BY dataset, cell_id ORDER BY vertex_no)),
k AS (SELECT p.id, p.dataset, p.x, p.y, cell_id FROM p JOIN c ON c.dataset = p.dataset AND p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1),
i AS (SELECT k.id, k.cell_id FROM k JOIN e ON e.dataset = k.dataset AND e.cell_id = k.cell_id
  WHERE (ay > y) <> (byy > y) AND x < (bx - ax) * (y - ay) / (byy - ay) + ax GROUP BY k.id, k.dataset, k.cell_id HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, id AS transcript_id, CAST(other AS VARCHAR) AS match_key FROM near UNION ALL SELECT 'inside', id, cell_id FROM i"""
QUERIES = {"p4_found": p4_found}
ORACLES = {"p4_found": _SQL}
