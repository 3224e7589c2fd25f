"""Neighbourhood, graph, clustering and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import geometry as geo
from cellwright.operators import graph, ordering
from cellwright.operators import spatial as sp
from cellwright.operators.knn import nearest_marked, spatial_knn, vector_search
from cellwright.plans.base import CELLS, TX, Book, cells, counts, tx
from cellwright.plans.basic import R
from cellwright.plans.expression import _GM, _PANEL, _top, panel_scores
from cellwright.runtime import cut, table

book = Book()
q = book.add


def placed(s, d):
    return cells(s, d).where("object = '10x_cell' AND x IS NOT NULL AND y IS NOT NULL")


def knn(s, d, k):
    return spatial_knn(placed(s, d).select("id", F.col("dataset").alias("frame"), "x", "y"), k)


_KNN = f"""WITH {CELLS.replace('{', '{{').replace('}', '}}')}, p AS (SELECT id, dataset, label, cluster, n_counts, x, y FROM cells WHERE object = '10x_cell' AND x IS NOT NULL AND y IS NOT NULL),
kn AS (SELECT * FROM (SELECT a.id, b.id AS nb, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) - 1 AS rank,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.dataset = b.dataset) WHERE rank < {{k}})"""
q("join_knn", _KNN.format(k=15) + " SELECT id, nb, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM kn")(lambda s, d: knn(s, d, 15).select("id", "nb", "rank", R("d2").alias("d2")))
q("knn_graph", "SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) - 1 AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank < 15")(
    lambda s, d: (lambda v: vector_search(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 15).select("qid", "id", F.col("rank").cast("bigint").alias("rank")))(table(s, d, "embeddings"))
)
_JAC = _KNN.format(k=10) + """, e AS (SELECT DISTINCT least(id, nb) AS u, greatest(id, nb) AS v FROM kn WHERE id <> nb), i AS (SELECT u, v, count(*) AS i FROM e JOIN kn a ON a.id = u JOIN kn b ON b.id = v AND b.nb = a.nb GROUP BY ALL),
c AS (SELECT id, count(*) AS c FROM kn GROUP BY id) SELECT u, v, CAST(coalesce(i, 0) AS DOUBLE) / (a.c + b.c - coalesce(i, 0)) AS w FROM e LEFT JOIN i USING (u, v) JOIN c a ON a.id = u JOIN c b ON b.id = v"""
q("phenograph_jaccard", _JAC)(lambda s, d: graph.jaccard_edges(cut(knn(s, d, 10))))


@q("phenograph")
def phenograph(s, d):
    """Jaccard-weighted neighbour graph per data set, modularity communities, labels by falling size."""
    near = cut(knn(s, d, 10))
    e = graph.jaccard_edges(near)
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    nodes = cut(placed(s, d).select(F.col("id").alias("loc"), F.xxhash64("dataset").alias("g")))
    work = cut(both.join(nodes.select(F.col("loc").alias("u"), "g"), "u").select("g", "u", "v", "w"))
    return graph.size_labels(graph.communities(nodes, work), 10).select(F.col("loc").alias("id"), "label")


q("neighbor_fractions", _KNN.format(k=20) + " SELECT kn.id, b.label, count(*) AS n FROM kn JOIN p b ON b.id = nb WHERE b.label IS NOT NULL GROUP BY ALL")(
    lambda s, d: sp.neighbour_labels(knn(s, d, 20), placed(s, d).where("label IS NOT NULL").select("id", "label"))
)
q("neighbor_fractions_by_label", _KNN.format(k=20) + " SELECT a.label AS center, b.label, count(*) AS n FROM kn JOIN p a ON a.id = kn.id JOIN p b ON b.id = nb WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY ALL")(
    lambda s, d: (lambda l: sp.neighbour_labels(knn(s, d, 20), l).join(l.withColumnRenamed("label", "center"), "id").groupBy("center", "label").agg(F.sum("n").alias("n")))(placed(s, d).where("label IS NOT NULL").select("id", "label"))
)
_NEAR = _KNN.format(k=500) + ", nd AS (SELECT kn.id, min(CASE WHEN d2 > 0 AND b.cluster = 2 THEN d2 END) AS d2 FROM kn JOIN p b ON b.id = nb GROUP BY kn.id)"
_near = lambda s, d: nearest_marked(placed(s, d).select("id", F.col("dataset").alias("frame"), "x", "y", (F.col("cluster") == 2).alias("mark")), 500)
q("dist_nearest_type", _NEAR + " SELECT id, round(sqrt(d2), 6) AS distance FROM nd")(lambda s, d: _near(s, d).select("id", R(F.sqrt("d2")).alias("distance")))
_RK = "{0} AS (SELECT module, id, rank() OVER (PARTITION BY module ORDER BY {1}) + (count(*) OVER (PARTITION BY module, {1}) - 1) / 2.0::DOUBLE AS r FROM j)"
q("module_correlation", _GM + ", " + _NEAR.split("WITH ", 1)[1] + ", " + _PANEL + ", j AS (SELECT module, nd.id, round(d2, 6) AS d2, round(score, 6) AS score FROM nd JOIN cells USING (id) JOIN sc ON sc.cell = vendor_id WHERE d2 IS NOT NULL AND l2 = 'Epithelial'), " + _RK.format("ra", "d2") + ", " + _RK.format("rb", "score") + " SELECT dense_rank() OVER (ORDER BY module) - 1 AS module, round(corr(ra.r, rb.r), 5) AS rho, count(*) AS n FROM ra JOIN rb USING (module, id) GROUP BY module")(
    lambda s, d: _module_correlation(s, d)
)


def _module_correlation(s, d):
    """Spearman correlation, over epithelial cells, of each module's score with the distance to the nearest cell of a type."""
    own = cells(s, d).where("l2 = 'Epithelial'").select("id", F.col("vendor_id").alias("cell"))
    rows = cut(_near(s, d).where("d2 IS NOT NULL").join(own, "id").join(panel_scores(s, d), "cell").select("module", R("d2").alias("d2"), R("score").alias("score")))
    return sp.spearman(rows, "d2", "score", ["module"]).select(F.col("module").cast("bigint").alias("module"), R("rho", 5).alias("rho"), "n")


def _placed_counts(s, d):
    """The matrix of the vendor's placed cells, by cell id."""
    ids = placed(s, d).where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("id").alias("id"))
    return cut(counts(s, d).join(ids.withColumnRenamed("vendor_id", "cell"), "cell").select(F.col("id").alias("cell"), "gene", "n"))


@q("hotspot_autocorr")
def hotspot_autocorr(s, d):
    """Spatial autocorrelation of all genes of at least 5 counts over the vendor's cells."""
    m = _placed_counts(s, d)
    return sp.autocorrelation(m, cut(knn(s, d, 20)), m.groupBy("gene").agg(F.sum("n").alias("t")).where("t >= 5").select("gene"))


def _modules(s, d, m):
    z = cut(sp.local_correlation(m, cut(knn(s, d, 20)), _top(m)))
    return ordering.modules(z, least=2.0)


@q("hotspot_modules")
def hotspot_modules(s, d):
    """Modules of the 40 commonest genes by local correlation; -1 for genes in none."""
    return _modules(s, d, _placed_counts(s, d))


@q("hotspot_module_scores")
def hotspot_module_scores(s, d):
    m = _placed_counts(s, d)
    return sp.module_scores(m, _modules(s, d, m))


q("clustering_scores", """WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT label, i, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM e GROUP BY ALL), a AS (SELECT i, sum(n)::DOUBLE AS nn, sum(s) AS t FROM b GROUP BY i)
SELECT round(sum(n * (s / n - t / nn) ** 2) / (count(DISTINCT label) - 1) / (sum(ss - s * s / n) / (max(nn) - count(DISTINCT label))), 6) AS score FROM b JOIN a USING (i)""")(
    lambda s, d: sp.calinski_harabasz(table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))).select(R("score").alias("score"))
)
q("silhouette", """WITH dd AS (SELECT a.vec_id AS qid, a.label AS la, b.label AS lb, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 GROUP BY ALL),
ab AS (SELECT qid, max(CASE WHEN la = lb THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM dd GROUP BY qid) SELECT qid, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS silhouette FROM ab""")(
    lambda s, d: (lambda v: sp.silhouette(v.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("q"))).select("qid", R("silhouette").alias("silhouette")))(table(s, d, "embeddings"))
)

# geometry
_PT = f"WITH {TX}, pt AS (SELECT DISTINCT a AS cell, x, y FROM tx WHERE a IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"
_pt = lambda s, d: tx(s, d, "a", "x", "y").dropna(subset=["a", "x", "y"]).select(F.col("a").alias("cell"), "x", "y").distinct()
q("geom_points", _PT + " SELECT cell, count(*) AS length, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM pt GROUP BY cell")(
    lambda s, d: _pt(s, d).groupBy("cell").agg(F.count("*").alias("length"), R(F.max("x") - F.min("x")).alias("width"), R(F.max("y") - F.min("y")).alias("height"))
)
q("generate_boundaries")(lambda s, d: geo.cell_outlines(_pt(s, d)))
q("cell_summary")(lambda s, d: geo.cell_hulls(_pt(s, d)))
q("geom_smooth")(lambda s, d: geo.smooth(geo.cell_outlines(_pt(s, d)), 0.5))
_VX = "vx AS (SELECT DISTINCT dataset, cell_id, vertex_no, vertex_x AS x, vertex_y AS y FROM cell_boundaries WHERE cell_id IS NOT NULL AND vertex_x IS NOT NULL AND vertex_y IS NOT NULL AND NOT isnan(vertex_x) AND NOT isnan(vertex_y))"
_RG = f"WITH {_VX}, r AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first(x) OVER (PARTITION BY dataset, cell_id ORDER BY vertex_no) AS fx, first(y) OVER (PARTITION BY dataset, cell_id ORDER BY vertex_no) AS fy FROM vx WINDOW w AS (PARTITION BY dataset, cell_id ORDER BY vertex_no))"


def rings(s, d):
    v = table(s, d, "cell_boundaries").where("cell_id IS NOT NULL AND vertex_x IS NOT NULL AND vertex_y IS NOT NULL AND NOT isnan(vertex_x) AND NOT isnan(vertex_y)")
    ring = F.sort_array(F.collect_set(F.struct("vertex_no", "vertex_x", "vertex_y")))
    return v.groupBy("dataset", "cell_id").agg(ring.alias("r")).where(F.size("r") >= 3).select("dataset", "cell_id", F.col("r.vertex_x").alias("xs"), F.col("r.vertex_y").alias("ys"))


_AREA = _RG + ", ar AS (SELECT dataset, cell_id, count(*) AS corners, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 AS area FROM r GROUP BY ALL HAVING count(*) >= 3)"
q("geom_from_xy", _AREA + " SELECT dataset, cell_id, corners, round(area, 4) AS area FROM ar")(lambda s, d: rings(s, d).select("dataset", "cell_id", F.size("xs").cast("bigint").alias("corners"), R(geo.shoelace("xs", "ys"), 4).alias("area")))
q("geom_largest", _AREA + " SELECT dataset, max(round(area, 4)) AS largest FROM ar GROUP BY dataset")(lambda s, d: rings(s, d).groupBy("dataset").agg(F.max(R(geo.shoelace("xs", "ys"), 4)).alias("largest")))
_IN = "greatest(100 - {0}, 0, {0} - 300)"
q("join_within", f"WITH {_VX} SELECT dataset, cell_id FROM vx GROUP BY ALL HAVING bool_and(greatest(100 - x, 0, x - 300) ** 2 + greatest(200 - y, 0, y - 500) ** 2 <= 400)")(
    lambda s, d: table(s, d, "cell_boundaries").where("cell_id IS NOT NULL AND vertex_x IS NOT NULL AND vertex_y IS NOT NULL AND NOT isnan(vertex_x) AND NOT isnan(vertex_y)").groupBy("dataset", "cell_id")
    .agg(F.bool_and(F.expr("power(greatest(100D - vertex_x, 0D, vertex_x - 300D), 2) + power(greatest(200D - vertex_y, 0D, vertex_y - 500D), 2) <= 400")).alias("ok")).where("ok").select("dataset", "cell_id")
)
q("geom_vector_angle", _RG + ", t AS (SELECT dataset, cell_id, vertex_no, nx - x AS ux, ny - y AS uy, fx - x AS vx, fy - y AS vy FROM r WHERE nx IS NOT NULL) SELECT dataset, cell_id, vertex_no, round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 4) AS angle FROM t WHERE (ux <> 0 OR uy <> 0) AND (vx <> 0 OR vy <> 0)")(
    lambda s, d: _angles(s, d)
)


def _angles(s, d):
    """Angle at each corner between the way to the next corner and the way to the first."""
    at = lambda c, i: F.element_at(c, i)
    e = rings_all(s, d).select("dataset", "cell_id", F.posexplode("r").alias("i", "p"), "r").where(F.col("i") < F.size("r") - 1)
    nxt, first = F.element_at("r", F.col("i") + 2), at(F.col("r"), F.lit(1))
    e = e.select("dataset", "cell_id", "p.vertex_no", *((n["vertex_x"] - F.col("p.vertex_x")).alias(f"{a}x") for n, a in ((nxt, "u"), (first, "v"))), *((n["vertex_y"] - F.col("p.vertex_y")).alias(f"{a}y") for n, a in ((nxt, "u"), (first, "v"))))
    e = e.where("(ux <> 0 OR uy <> 0) AND (vx <> 0 OR vy <> 0)")
    return e.selectExpr("dataset", "cell_id", "vertex_no", "round(degrees(acos(greatest(-1D, least(1D, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 4) AS angle")


def rings_all(s, d):
    v = table(s, d, "cell_boundaries").where("cell_id IS NOT NULL AND vertex_x IS NOT NULL AND vertex_y IS NOT NULL AND NOT isnan(vertex_x) AND NOT isnan(vertex_y)")
    return v.groupBy("dataset", "cell_id").agg(F.sort_array(F.collect_set(F.struct("vertex_no", "vertex_x", "vertex_y"))).alias("r"))


q("viewport_counts", f"WITH {TX} SELECT dataset, count(DISTINCT a) AS cells, count(*) AS molecules, count(*) FILTER (starts_with(gene, 'BLANK')) AS negative FROM tx WHERE x BETWEEN 100 AND 400 AND y BETWEEN 100 AND 500 GROUP BY dataset")(
    lambda s, d: tx(s, d, "dataset", "a", "gene", "x", "y").where("x BETWEEN 100 AND 400 AND y BETWEEN 100 AND 500").groupBy("dataset").agg(F.count_distinct("a").alias("cells"), F.count("*").alias("molecules"), F.count_if(F.startswith("gene", F.lit("BLANK"))).alias("negative"))
)
q("geom_d_max", _PT + ", nn AS (SELECT a.cell, a.x, a.y, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM pt a JOIN pt b ON a.cell = b.cell AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL) SELECT cell, round(sqrt(max(d2)), 6) AS d_max FROM nn GROUP BY cell")(
    lambda s, d: spatial_knn(_pt(s, d).select(F.xxhash64("cell", "x", "y").alias("id"), F.col("cell").alias("frame"), "x", "y"), 1, include_self=False).join(_pt(s, d).select(F.xxhash64("cell", "x", "y").alias("id"), "cell"), "id").groupBy("cell").agg(R(F.sqrt(F.max("d2"))).alias("d_max"))
)
