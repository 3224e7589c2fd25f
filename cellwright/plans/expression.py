"""Matrix, marker and test queries over the vendor's cells, typed by their level-1 family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators import markers as mk
from cellwright.operators import matrix as mx
from cellwright.operators import tables as tab
from cellwright.operators.spatial import module_scores
from cellwright.plans.base import CELLS, COUNTS, GENE_SQL, SPACE, SPACE_SQL, TYPED, Book, Study, cells, counts, gene, tx
from cellwright.plans.basic import R
from cellwright.runtime import cut, table

book = Book()
q = book.add
_M = f"WITH {COUNTS}"
_MT = f"""{_M}, {TYPED}, mt AS (SELECT m.*, type FROM m JOIN typed USING (cell)), sz AS (SELECT type, count(DISTINCT cell) AS cells FROM mt GROUP BY type),
tg AS (SELECT s.type, g.gene, s.cells, coalesce(e, 0) AS expressing, coalesce(t, 0) AS total FROM sz s, (SELECT DISTINCT gene FROM mt) g
  LEFT JOIN (SELECT type, gene, count(*) AS e, sum(n)::BIGINT AS t FROM mt GROUP BY ALL) h ON h.type = s.type AND h.gene = g.gene)"""
_MK = _MT + """, me AS (SELECT *, CAST(total AS DOUBLE) / cells AS mean FROM tg), ed AS (SELECT type, quantile_cont(mean, 0.95) AS top, quantile_cont(mean, 0.1) AS bottom FROM me GROUP BY type),
mk AS (SELECT type, gene, 'positive' AS kind FROM me JOIN ed USING (type) WHERE mean >= top AND CAST(expressing AS DOUBLE) / cells >= 0.5
  UNION ALL SELECT type, gene, 'negative' FROM me JOIN ed USING (type) WHERE mean <= bottom)"""
_EX = _MK + """, wh AS (SELECT gene, sum(cells)::BIGINT AS ac, sum(expressing)::BIGINT AS ae FROM tg GROUP BY gene),
ex AS (SELECT type, gene FROM tg JOIN wh USING (gene) WHERE (type, gene) IN (SELECT (type, gene) FROM mk WHERE kind = 'positive')
  AND CAST(expressing AS DOUBLE) / cells > 0.2 AND CASE WHEN ac > cells THEN CAST(ae - expressing AS DOUBLE) / (ac - cells) END < 0.05),
pr AS (SELECT DISTINCT a.gene AS g1, b.gene AS g2 FROM ex a JOIN ex b ON a.type < b.type)"""

q("find_markers", _MK + " SELECT * FROM mk")(lambda s, d: Study(s, d).markers)
q("mutually_exclusive_genes", _EX + " SELECT * FROM pr")(lambda s, d: Study(s, d).pairs)
q("join_pairs_combinations", _MK + " SELECT a.type AS t1, b.type AS t2, a.gene AS g1, b.gene AS g2 FROM mk a JOIN mk b ON a.type < b.type AND a.kind = 'positive' AND b.kind = 'positive'")(
    lambda s, d: (lambda p: p.select(F.col("type").alias("t1"), F.col("gene").alias("g1")).join(p.select(F.col("type").alias("t2"), F.col("gene").alias("g2")), F.col("t1") < F.col("t2")))(Study(s, d).markers.where("kind = 'positive'"))
)
q("mecr", _EX + """, n AS (SELECT gene, count(*) AS n FROM m GROUP BY gene), bo AS (SELECT g1, g2, count(*) AS b FROM pr JOIN m x ON x.gene = g1 JOIN m y ON y.gene = g2 AND y.cell = x.cell GROUP BY ALL)
SELECT g1, g2, coalesce(CAST(coalesce(b, 0) AS DOUBLE) / nullif(a.n + c.n - coalesce(b, 0), 0), 0) AS rate FROM pr JOIN n a ON a.gene = g1 JOIN n c ON c.gene = g2 LEFT JOIN bo USING (g1, g2)""")(
    lambda s, d: (lambda w: mk.mecr(w.m, w.pairs))(Study(s, d))
)
_TOP = "top AS (SELECT gene FROM m GROUP BY gene ORDER BY sum(n) DESC, gene LIMIT 40)"
_top = lambda m, k=40: m.groupBy("gene").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "gene").limit(k).select("gene")
q("join_coexpr", _M + " SELECT x.gene AS g1, y.gene AS g2, count(*) AS both FROM m x JOIN m y ON y.cell = x.cell AND x.gene < y.gene GROUP BY ALL")(
    lambda s, d: mx.cross_products(cut(counts(s, d)), "n").select("g1", "g2", "both")
)
q("sensitivity", _MK + " SELECT cell, mt.type, sum(CASE WHEN k.gene IS NOT NULL THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS value FROM mt LEFT JOIN mk k ON k.type = mt.type AND k.gene = mt.gene AND k.kind = 'positive' GROUP BY cell, mt.type")(
    lambda s, d: (lambda w: mk.sensitivity(w.m, w.typed, w.markers))(Study(s, d))
)
q("marker_capture", _MK + " SELECT type, count(*) AS found, count(p.gene) AS on_panel, CAST(count(p.gene) AS DOUBLE) / count(*) AS ratio FROM mk LEFT JOIN (SELECT DISTINCT upper(gene) AS gene FROM gene_panel) p USING (gene) WHERE kind = 'positive' GROUP BY type")(
    lambda s, d: Study(s, d).markers.where("kind = 'positive'").join(table(s, d, "gene_panel").select(F.upper("gene").alias("gene"), F.lit(1).alias("p")).distinct(), "gene", "left").groupBy("type").agg(F.count("*").alias("found"), F.count("p").alias("on_panel"), (F.count("p").cast("double") / F.count("*")).alias("ratio"))
)
_MOM = _MT + ", mo AS (SELECT type, gene, cells, total AS s, coalesce(ss, 0) AS ss FROM tg LEFT JOIN (SELECT type, gene, sum(n * n)::BIGINT AS ss FROM mt GROUP BY ALL) USING (type, gene)), al AS (SELECT gene, sum(cells)::BIGINT AS ac, sum(s)::BIGINT AS a_s, sum(ss)::BIGINT AS ass FROM mo GROUP BY gene)"


def _moments(s, d):
    w = Study(s, d)
    ss = w.m.join(w.typed, "cell").groupBy("type", "gene").agg(F.sum(F.col("n") * F.col("n")).alias("ss"))
    return cut(w.tg.withColumnRenamed("total", "s").join(ss, ["type", "gene"], "left").fillna(0, ["ss"]))


_WELCH = _MOM + """, w AS (SELECT type, gene, cells::DOUBLE AS n1, (ac - cells)::DOUBLE AS n2, s / cells::DOUBLE AS m1, (a_s - s) / (ac - cells)::DOUBLE AS m2, ss, ass - ss AS r FROM mo JOIN al USING (gene) WHERE cells > 1 AND ac - cells > 1),
v AS (SELECT *, (ss - n1 * m1 * m1) / (n1 - 1) / n1 AS v1, (r - n2 * m2 * m2) / (n2 - 1) / n2 AS v2 FROM w)
SELECT type, gene, round(m1, 6) AS mean_in, round(m2, 6) AS mean_out, round((m1 - m2) / nullif(sqrt(v1 + v2), 0), 5) AS t FROM v"""
q("rank_genes_ttest", _WELCH)(lambda s, d: mk.one_vs_rest_t(_moments(s, d)).select("type", "gene", R("mean_in").alias("mean_in"), R("mean_out").alias("mean_out"), R("t", 5).alias("t")))
_RANK = _MT + """, nn AS (SELECT sum(cells)::BIGINT AS big FROM sz), lv AS (SELECT gene, n, count(*) AS k FROM mt GROUP BY ALL),
rk AS (SELECT gene, n, k, z, z + sum(k) OVER (PARTITION BY gene ORDER BY n)::BIGINT - (k - 1) / 2.0::DOUBLE AS rank FROM lv JOIN (SELECT gene, any_value(big) - sum(k)::BIGINT AS z FROM lv, nn GROUP BY gene) USING (gene)),
su AS (SELECT mt.gene, type, sum(rank) AS r, count(*) AS have, any_value(z) AS z FROM mt JOIN rk ON rk.gene = mt.gene AND rk.n = mt.n GROUP BY ALL)
SELECT type, gene, r + (cells - have) * (z + 1) / 2.0::DOUBLE - cells * (cells + 1) / 2.0::DOUBLE AS u FROM su JOIN sz USING (type)"""
q("rank_genes_wilcoxon", _RANK)(lambda s, d: _ranked(Study(s, d)).select("type", "gene", "u"))
#: Two-sided p of a standard normal z: the error function as its power series.
_P = "CASE WHEN abs(z) < 5.6 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda i: power(-1, i) * power(abs(z) / sqrt(2), 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))) ELSE 0 END"
_WZ = _RANK.replace("SELECT type, gene, r +", ", ti AS (SELECT gene, sum(k::DOUBLE ** 3 - k) + any_value(z::DOUBLE ** 3 - z) AS ties FROM rk GROUP BY gene), wu AS (SELECT type, gene, cells::DOUBLE AS n1, (big - cells)::DOUBLE AS n2, big::DOUBLE AS big, ties, r +") + """ JOIN ti USING (gene), nn),
wz AS (SELECT type, gene, u, (u - n1 * n2 / 2) / nullif(sqrt(n1 * n2 / 12 * (big + 1 - ties / (big * (big - 1)))), 0) AS z FROM wu),
wp AS (SELECT *, """ + _P + """ AS p FROM wz WHERE z IS NOT NULL),
wq AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY type ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY type) AS m, count(*) OVER (PARTITION BY type ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM wp))"""
_LFC = "f AS (SELECT type, gene, round(log2(((total + 1.0::DOUBLE) / cells) / ((a.t - total + 1.0::DOUBLE) / (a.c - cells))), 6) AS lfc FROM tg JOIN (SELECT gene, sum(total)::BIGINT AS t, sum(cells)::BIGINT AS c FROM tg GROUP BY gene) a USING (gene) WHERE a.c > cells)"


def _ranked(w):
    return mk.rank_sum(w.m, w.typed)


def _wilcoxon(w):
    """(type, gene, u, z, p, q): Wilcoxon rank sums with two-sided normal p, and Benjamini-Hochberg's q per type."""
    z = cut(_ranked(w).where("z IS NOT NULL").withColumn("p", mk.two_sided("z")))
    return mk.benjamini_hochberg(z, ["type"], "p", "q")


def _fold(w):
    a = w.tg.groupBy("gene").agg(F.sum("total").alias("t"), F.sum("cells").alias("c"))
    ratio = ((F.col("total") + 1.0) / F.col("cells")) / ((F.col("t") - F.col("total") + 1.0) / (F.col("c") - F.col("cells")))
    return w.tg.join(a, "gene").where("c > cells").select("type", "gene", R(F.log2(ratio)).alias("lfc"))


def _tested(s, d):
    """(type, gene, lfc, p) of every type and gene that occurs in it."""
    w = Study(s, d)
    return _fold(w).join(_wilcoxon(w).select("type", "gene", "p"), ["type", "gene"])


q("wilcoxon_adjusted", _WZ + " SELECT type, gene, round(p, 6) AS p, round(q, 6) AS p_adjusted FROM wq")(
    lambda s, d: _wilcoxon(Study(s, d)).select("type", "gene", R("p").alias("p"), R("q").alias("p_adjusted"))
)


@q("ttest_adjusted")
def ttest_adjusted(s, d):
    """Welch's test with p of Student's t and Benjamini-Hochberg adjustment per type."""
    t = cut(mk.one_vs_rest_t(_moments(s, d)).where("t IS NOT NULL AND df IS NOT NULL").withColumn("p", mk.two_sided_t("t", "df")))
    return mk.benjamini_hochberg(t, ["type"], "p", "p_adjusted")


q("deg_filter", _WZ + ", " + _LFC + " SELECT gene, type, lfc, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY lfc DESC, type) AS r FROM f JOIN wp USING (type, gene) WHERE lfc > 1 AND p < 0.01) WHERE r = 1")(
    lambda s, d: tab.first_per(_tested(s, d).where("lfc > 1 AND p < 0.01"), ["gene"], F.desc("lfc"), "type").select("gene", "type", "lfc", R("p").alias("p"))
)
q("volcano_significance", _WZ + ", " + _LFC + " SELECT type, gene, lfc, round(p, 6) AS p, lfc NOT BETWEEN -1 AND 1 AND p < 0.01 AS significant FROM f JOIN wp USING (type, gene)")(
    lambda s, d: _tested(s, d).select("type", "gene", "lfc", R("p").alias("p"), (~F.col("lfc").between(-1, 1) & (F.col("p") < 0.01)).alias("significant"))
)
q("group_markers")(lambda s, d: mk.group_markers(Study(s, d).tg))
q("get_group_markers")(lambda s, d: mk.group_markers(Study(s, d).tg).where("marker").groupBy("type").agg(F.sort_array(F.collect_list("gene")).alias("genes")))  # a type's markers, of the panel's genes

# matrix
q("anndata_from_transcripts", f"{_M} SELECT g.gene, coalesce(sum(n), 0)::BIGINT AS n, count(m.cell) AS cells FROM (SELECT DISTINCT gene FROM tx WHERE gene IS NOT NULL) g LEFT JOIN m USING (gene) GROUP BY g.gene")(
    lambda s, d: tx(s, d, "gene", "a").where("gene IS NOT NULL").groupBy("gene", "a").agg(F.count("*").alias("n")).groupBy("gene").agg(F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count("a").alias("cells"))
)  # genes seen only outside cells stay, with zeros
_TOT = "t AS (SELECT cell, sum(n)::BIGINT AS total FROM m GROUP BY cell)"
_NORM = f"{_M}, {_TOT}, nm AS (SELECT cell, gene, n, n * (SELECT quantile_cont(total, 0.5) FROM t) / total AS norm FROM m JOIN t USING (cell))"
q("normalize_total", _NORM + " SELECT cell, gene, round(norm, 6) AS norm FROM nm")(lambda s, d: mx.normalize_total(counts(s, d)).select("cell", "gene", R("norm").alias("norm")))
q("log1p", _NORM + " SELECT cell, gene, round(ln(1 + norm), 6) AS lognorm FROM nm")(lambda s, d: mx.log1p(mx.normalize_total(counts(s, d))).select("cell", "gene", R("log_norm").alias("lognorm")))
_GM = _M + ", c AS (SELECT count(DISTINCT cell) AS c FROM m), gm AS (SELECT gene, sum(n)::DOUBLE / any_value(c) AS mean, sqrt(sum(n * n)::DOUBLE / any_value(c) - (sum(n)::DOUBLE / any_value(c)) ** 2) AS sd FROM m, c GROUP BY gene)"
q("zscore_layer", _GM + " SELECT cell, gene, round((n - mean) / nullif(sd, 0), 5) AS z FROM m JOIN gm USING (gene)")(lambda s, d: mx.zscore(counts(s, d), "n").select("cell", "gene", R("z", 5).alias("z")))
_COR = _GM + ", xy AS (SELECT x.gene AS g1, y.gene AS g2, sum(x.n * y.n)::DOUBLE AS xy FROM m x JOIN m y ON y.cell = x.cell AND x.gene < y.gene GROUP BY ALL), co AS (SELECT a.gene AS g1, b.gene AS g2, (coalesce(xy, 0) / c - a.mean * b.mean) / nullif(a.sd * b.sd, 0) AS r FROM gm a JOIN gm b ON a.gene < b.gene LEFT JOIN xy ON g1 = a.gene AND g2 = b.gene, c)"
q("corr_matrix", _COR + " SELECT g1, g2, round(r, 5) AS r FROM co")(lambda s, d: mx.correlations(cut(counts(s, d)), "n").select("g1", "g2", R("r", 5).alias("r")))
q("kneepoint", f"{_M}, g AS (SELECT gene, sum(n)::DOUBLE AS t FROM m GROUP BY gene), o AS (SELECT row_number() OVER (ORDER BY t, gene) - 1 AS idx, t AS value FROM g), e AS (SELECT min(value) AS a, max(value) AS b, count(*) - 1.0::DOUBLE AS k FROM o) SELECT idx, value FROM o, e ORDER BY round(abs(k * (value - a) - (b - a) * idx) / sqrt(k * k + (b - a) ** 2), 9) DESC, idx LIMIT 1")(
    lambda s, d: (lambda g: mx.kneepoint(g.withColumn("o", F.struct("t", "gene")), "o", "t").select(F.col("idx").cast("bigint").alias("idx"), "value"))(counts(s, d).groupBy("gene").agg(F.sum("n").alias("t")))
)
q("auto_min_counts", f"{_M}, {_TOT}, o AS (SELECT total, log10(total) AS v, row_number() OVER (ORDER BY total) - 1 AS idx FROM t), e AS (SELECT min(v) AS a, max(v) AS b, count(*) - 1.0::DOUBLE AS k FROM o), kp AS (SELECT total FROM o, e ORDER BY round(abs(k * (v - a) - (b - a) * idx) / sqrt(k * k + (b - a) ** 2), 9) DESC, idx LIMIT 1) SELECT least(30, greatest(total, 5))::BIGINT AS least_counts FROM kp")(
    lambda s, d: mx.knee_of_totals(mx.totals(counts(s, d)), "total").select(F.least(F.lit(30).cast("long"), F.greatest(F.lit(5).cast("long"), "value")).alias("least_counts"))
)
q("minmax_heatmap", _MT + ", h AS (SELECT type, gene, CAST(total AS DOUBLE) / cells AS mean FROM tg) SELECT type, gene, round(coalesce((mean - min(mean) OVER (PARTITION BY gene)) / nullif(max(mean) OVER (PARTITION BY gene) - min(mean) OVER (PARTITION BY gene), 0), 0), 6) AS value FROM h")(
    lambda s, d: (lambda h, w: h.select("type", "gene", R(F.coalesce(F.try_divide(F.col("mean") - F.min("mean").over(w), F.max("mean").over(w) - F.min("mean").over(w)), F.lit(0.0))).alias("value")))(
        Study(s, d).tg.withColumn("mean", F.col("total").cast("double") / F.col("cells")), Window.partitionBy("gene"))
)
_BLOCK = ", mx AS (SELECT gene, max(CAST(total AS DOUBLE) / cells) AS top FROM tg GROUP BY gene), kb AS (SELECT gene, min(type) AS block FROM tg JOIN mx USING (gene) WHERE CAST(total AS DOUBLE) / cells = top GROUP BY gene)"
q("agg_block_sum", _COR.replace(_M, _MT, 1) + _BLOCK + ", al AS (SELECT g1, g2, coalesce(r, 0) AS r FROM co UNION ALL SELECT g2, g1, coalesce(r, 0) FROM co UNION ALL SELECT gene, gene, CASE WHEN sd > 0 THEN 1.0::DOUBLE ELSE 0 END FROM gm) SELECT a.block AS b1, b.block AS b2, round(sum(r), 3) AS total FROM al JOIN kb a ON a.gene = g1 JOIN kb b ON b.gene = g2 GROUP BY ALL")(
    lambda s, d: _blocks(Study(s, d))
)


def _blocks(w):
    """Sums of the full correlation matrix over blocks of genes, a gene's block being the type of its highest mean."""
    mean = (F.col("total").cast("double") / F.col("cells")).alias("mean")
    block = w.tg.select("gene", "type", mean).groupBy("gene").agg(F.min_by("type", F.struct(-F.col("mean"), "type")).alias("block"))
    r = cut(mx.correlations(w.m, "n").fillna(0.0, ["r"]))
    own = mx.gene_moments(w.m, "n").select(F.col("gene").alias("g1"), F.col("gene").alias("g2"), F.when(F.col("sd") > 0, 1.0).otherwise(0.0).alias("r"))
    every = r.unionByName(r.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "r")).unionByName(own)
    side = lambda k: block.select(F.col("gene").alias(f"g{k}"), F.col("block").alias(f"b{k}"))
    return every.join(side(1), "g1").join(side(2), "g2").groupBy("b1", "b2").agg(R(F.sum("r"), 3).alias("total"))


q("gene_set_score", _GM + f", {_TOP}, z AS (SELECT cell, gene, (n - mean) / nullif(sd, 0) AS z, mean / nullif(sd, 0) AS z0 FROM m JOIN gm USING (gene)), g0 AS (SELECT sum(CASE WHEN gene IN (SELECT gene FROM top) THEN mean / nullif(sd, 0) END) AS s1, sum(CASE WHEN gene NOT IN (SELECT gene FROM top) THEN mean / nullif(sd, 0) END) AS s2, count(*) FILTER (gene IN (SELECT gene FROM top)) AS k1, count(*) FILTER (gene NOT IN (SELECT gene FROM top)) AS k2 FROM gm) SELECT cell, round((coalesce(sum(CASE WHEN gene IN (SELECT gene FROM top) THEN z + z0 END), 0) - any_value(s1)) / any_value(k1) - (coalesce(sum(CASE WHEN gene NOT IN (SELECT gene FROM top) THEN z + z0 END), 0) - any_value(s2)) / any_value(k2), 4) AS score FROM z, g0 GROUP BY cell")(
    lambda s, d: _score(counts(s, d))
)


def _score(m):
    """Mean z of the set's genes minus the mean z of all others; absent entries count with their gene's z of zero."""
    mine = _top(m).withColumn("inset", F.lit(True))
    mom = mx.gene_moments(m, "n").join(mine, "gene", "left").withColumn("inset", F.coalesce("inset", F.lit(False))).withColumn("z0", F.try_divide("mean", "sd"))
    part = lambda c, k: F.sum(F.when(F.col("inset") == k, F.col(c)))
    base = F.broadcast(mom.agg(part("z0", True).alias("s1"), part("z0", False).alias("s2"), F.count_if(F.col("inset")).alias("k1"), F.count_if(~F.col("inset")).alias("k2")))
    z = m.join(mom, "gene").withColumn("up", F.try_divide(F.col("n"), F.col("sd")))
    per = z.groupBy("cell").agg(F.coalesce(part("up", True), F.lit(0.0)).alias("u1"), F.coalesce(part("up", False), F.lit(0.0)).alias("u2")).crossJoin(base)
    return per.select("cell", R((F.col("u1") - F.col("s1")) / F.col("k1") - (F.col("u2") - F.col("s2")) / F.col("k2"), 4).alias("score"))


q("downsample_counts")(lambda s, d: mx.downsample(counts(s, d), 20))
q("agg_pseudobulk_random")(lambda s, d: mx.pseudobulk(counts(s, d), 6))
q("deseq2_size_factors", _M + ", tt AS (SELECT split_part(cell, '/', 1) AS sample, gene, sum(n)::BIGINT AS n FROM m GROUP BY ALL), cm AS (SELECT gene, avg(ln(n)) AS geo FROM tt GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample) FROM tt)) SELECT sample, round(exp(quantile_cont(ln(n) - geo, 0.5)), 5) AS factor FROM tt JOIN cm USING (gene) GROUP BY sample")(
    lambda s, d: mx.size_factors(counts(s, d).groupBy(F.split_part("cell", F.lit("/"), F.lit(1)).alias("sample"), "gene").agg(F.sum("n").alias("n"))).select("sample", R("factor", 5).alias("factor"))
)

# annotation
_CELLS = "WITH " + TYPED.split(", typed AS")[0]
q("celltypist_annotate", _CELLS + ", n AS (SELECT dataset, object, cluster, label, count(*) AS n FROM cells WHERE cluster >= 0 AND label IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER w::BIGINT AS t, row_number() OVER (PARTITION BY dataset, object, cluster ORDER BY n DESC, label) AS r FROM n WINDOW w AS (PARTITION BY dataset, object, cluster)) SELECT c.id, CASE WHEN CAST(r.n AS DOUBLE) / t < 0.2 THEN 'Heterogeneous' ELSE r.label END AS vote FROM cells c JOIN r USING (dataset, object, cluster) WHERE r.r = 1")(
    lambda s, d: _vote(cells(s, d))
)


def _vote(c, least=0.2):
    """The cluster's most frequent label, or Heterogeneous where it has less than ``least`` of the cluster."""
    key = ["dataset", "object", "cluster"]
    n = c.where("cluster >= 0 AND label IS NOT NULL").groupBy(*key, "label").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy(*key)))
    top = tab.first_per(n, key, F.desc("n"), "label")
    return c.join(top.withColumnRenamed("label", "top"), key).select("id", F.when(F.col("n").cast("double") / F.col("t") < least, "Heterogeneous").otherwise(F.col("top")).alias("vote"))


_SH = "h AS (SELECT id, [prob, 1 - prob] AS p FROM cells WHERE prob > 0 AND prob < 1)"
q("fn_entropy", f"{_CELLS}, {_SH} SELECT id, round(-(p[1] * ln(p[1]) + p[2] * ln(p[2])), 6) AS entropy FROM h")(
    lambda s, d: cells(s, d).where("prob > 0 AND prob < 1").select("id", R(-(F.col("prob") * F.ln("prob") + (1 - F.col("prob")) * F.ln(1 - F.col("prob")))).alias("entropy"))
)
q("map_10x_ids", f"{_M.replace('WITH ', 'WITH ', 1)}, ab AS (SELECT b, a, count(*) AS n FROM tx WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL) SELECT b, a AS vendor_id FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS r FROM ab) WHERE r = 1")(
    lambda s, d: tab.argmax_partner(tx(s, d, "a", "b"), "b", "a").select("b", F.col("a").alias("vendor_id"))
)
q("neutrophil_override", f"{_CELLS}, k AS (SELECT DISTINCT vendor_id FROM cells WHERE object = '10x_cell' AND cluster = 2) SELECT c.id, CASE WHEN k.vendor_id IS NOT NULL THEN 'Override' ELSE label END AS label FROM cells c LEFT JOIN k USING (vendor_id) WHERE object = 'segger'")(
    lambda s, d: (lambda c: c.where("object = 'segger'").join(c.where("object = '10x_cell' AND cluster = 2").select("vendor_id", F.lit(True).alias("hit")).distinct(), "vendor_id", "left").select("id", F.when(F.col("hit"), "Override").otherwise(F.col("label")).alias("label")))(cells(s, d))
)
q("in_other_segmentation", f"{_CELLS} SELECT id, vendor_id IN (SELECT vendor_id FROM cells WHERE object = '10x_nucleus' AND vendor_id IS NOT NULL) AS found FROM cells WHERE object = 'segger' AND vendor_id IS NOT NULL")(
    lambda s, d: (lambda c: c.where("object = 'segger' AND vendor_id IS NOT NULL").join(c.where("object = '10x_nucleus' AND vendor_id IS NOT NULL").select("vendor_id", F.lit(True).alias("hit")).distinct(), "vendor_id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("found")))(cells(s, d))
)
q("nuclear_fraction", f"{_M} SELECT a AS cell, CAST(sum(pos) AS DOUBLE) / count(*) AS fraction FROM tx WHERE a IS NOT NULL GROUP BY a")(
    lambda s, d: tx(s, d, "a", "pos").where("a IS NOT NULL").groupBy(F.col("a").alias("cell")).agg((F.sum("pos").cast("double") / F.count("*")).alias("fraction"))
)
q("celltype_proportions", f"{_CELLS} SELECT object, label, count(*) AS n FROM cells WHERE prob >= 0.5 AND NOT isnan(prob) AND label IS NOT NULL GROUP BY ALL")(
    lambda s, d: cells(s, d).where("prob >= 0.5 AND NOT isnan(prob) AND label IS NOT NULL").groupBy("object", "label").agg(F.count("*").alias("n"))
)
q("umi_quantiles", f"{_CELLS} SELECT object, quantile_cont(n_counts, 0.05) AS q05, quantile_cont(n_counts, 0.25) AS q25, quantile_cont(n_counts, 0.05) FILTER (n_counts > 10) AS q05_over, quantile_cont(n_counts, 0.25) FILTER (n_counts > 10) AS q25_over FROM cells GROUP BY object")(
    lambda s, d: cells(s, d).withColumn("over", F.when(F.col("n_counts") > 10, F.col("n_counts"))).groupBy("object").agg(*(F.percentile(c, p).alias(n) for c, p, n in (("n_counts", 0.05, "q05"), ("n_counts", 0.25, "q25"), ("over", 0.05, "q05_over"), ("over", 0.25, "q25_over"))))
)
_KIND = "CASE WHEN {0} = 2 THEN 'Chosen' ELSE 'Rest' END"
q("neutrophil_vs_rest", f"""{_M}, {CELLS}, nf AS (SELECT a AS cell, CAST(sum(pos) AS DOUBLE) / count(*) AS f FROM tx WHERE a IS NOT NULL GROUP BY a), pk AS (SELECT cluster, gene, sum(n) AS n FROM m JOIN cells ON vendor_id = cell AND object = '10x_cell' WHERE cluster IS NOT NULL GROUP BY ALL),
pm AS (SELECT cluster, count(*) AS found, count(*) FILTER (gene IN (SELECT upper(gene) FROM gene_panel)) AS panel FROM pk GROUP BY cluster)
SELECT 'counts' AS measure, {_KIND.format("cluster")} AS kind, count(*) AS n, round(avg(n_counts), 6) AS value FROM cells WHERE object = 'segger' AND n_counts IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'percent nuclear', {_KIND.format("cluster")}, count(*), round(avg(f * 100), 6) FROM cells JOIN nf ON cell = vendor_id WHERE object = 'segger' AND cluster IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'panel genes', {_KIND.format("cluster")}, count(*), round(avg(panel), 6) FROM pm GROUP BY ALL
UNION ALL SELECT 'percent in nuclei', {_KIND.format("cluster")}, count(*), round(avg(CASE WHEN vendor_id IN (SELECT vendor_id FROM cells WHERE object = '10x_nucleus' AND vendor_id IS NOT NULL) THEN 100.0 ELSE 0 END)::DOUBLE, 6) FROM cells WHERE object = 'segger' AND cluster IS NOT NULL AND vendor_id IS NOT NULL GROUP BY ALL""")(
    lambda s, d: _chosen_vs_rest(s, d)
)


def _chosen_vs_rest(s, d):
    """Counts, nuclear share, panel genes and share found in the nuclei's object, of the chosen cluster and of the rest."""
    c = cut(cells(s, d).where("cluster IS NOT NULL"))
    own = c.where("object = 'segger'")
    nuclear = tx(s, d, "a", "pos").where("a IS NOT NULL").groupBy(F.col("a").alias("vendor_id")).agg((F.sum("pos").cast("double") / F.count("*") * 100).alias("v"))
    panel = table(s, d, "gene_panel").select(F.upper("gene").alias("gene"), F.lit(1).alias("hit")).distinct()
    seen = counts(s, d).join(c.where("object = '10x_cell'").select(F.col("vendor_id").alias("cell"), "cluster"), "cell").select("cluster", "gene").distinct()
    nuclei = cells(s, d).where("object = '10x_nucleus' AND vendor_id IS NOT NULL").select("vendor_id", F.lit(100.0).alias("hit")).distinct()
    frames = {
        "counts": own.where("n_counts IS NOT NULL").select("cluster", F.col("n_counts").cast("double").alias("v")),
        "percent nuclear": own.join(nuclear, "vendor_id").select("cluster", "v"),
        "panel genes": seen.join(panel, "gene", "left").groupBy("cluster").agg(F.count("hit").cast("double").alias("v")),
        "percent in nuclei": own.where("vendor_id IS NOT NULL").join(nuclei, "vendor_id", "left").select("cluster", F.coalesce("hit", F.lit(0.0)).alias("v")),
    }
    every = reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("measure"), F.when(F.col("cluster") == 2, "Chosen").otherwise("Rest").alias("kind"), "v") for k, f in frames.items()))
    return every.groupBy("measure", "kind").agg(F.count("*").alias("n"), R(F.avg("v")).alias("value"))


q("compartment_by_label", "SELECT label, compartment FROM (SELECT label, compartment, row_number() OVER (PARTITION BY label ORDER BY marker_id, compartment) AS r FROM marker_annotations WHERE label IS NOT NULL AND compartment IS NOT NULL) WHERE r = 1")(
    lambda s, d: tab.first_per(table(s, d, "marker_annotations").where("label IS NOT NULL AND compartment IS NOT NULL"), ["label"], "marker_id", "compartment").select("label", "compartment")
)
_SPOKEN = "lower(trim(regexp_replace({0}, '" + SPACE_SQL.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')))"
q("marker_aggregation", f"""WITH g AS (SELECT *, {GENE_SQL.format("gene")} AS sym FROM marker_annotations), names AS (SELECT lower(name) AS said, cell_type_id FROM cell_types), others AS (SELECT lower(unnest(aliases)) AS said, cell_type_id FROM cell_types),
u AS (SELECT sym AS gene, source, cell_type_id FROM g JOIN names ON said = {_SPOKEN.format("label")} UNION SELECT sym, source, cell_type_id FROM g JOIN others ON said = {_SPOKEN.format("label")} UNION SELECT sym, source, cell_type_id FROM g JOIN names ON said = {_SPOKEN.format('"group"')})
SELECT u.gene, t.name AS label, t.compartment, u.source, t.level_1, t.level_2 FROM u JOIN cell_types t USING (cell_type_id) WHERE u.gene IS NOT NULL""")(lambda s, d: _markers(s, d))


def _markers(s, d):
    """Markers of three readings - labels by name, labels by alias, groups by name - united over their common columns, named and levelled by the reference list."""
    spoken = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), SPACE, " ")))
    g = table(s, d, "marker_annotations").select(gene("gene").alias("gene"), "source", spoken("label").alias("label"), spoken("`group`").alias("group")).where("gene IS NOT NULL")
    types = table(s, d, "cell_types")
    names = types.select(F.lower("name").alias("said"), "cell_type_id")
    others = types.select(F.explode(F.transform("aliases", F.lower)).alias("said"), "cell_type_id")
    read = lambda c, by: g.join(by, F.col(c) == F.col("said")).select("gene", "source", "cell_type_id", F.lit(c).alias("read_from"), *([] if by is names else ["said"]))
    u = tab.union_common(read("label", names), read("label", others), read("group", names)).drop("read_from").distinct()
    return u.join(types.select("cell_type_id", F.col("name").alias("label"), "compartment", "level_1", "level_2"), "cell_type_id").select("gene", "label", "compartment", "source", "level_1", "level_2")


_PANEL = """pg AS (SELECT DISTINCT panel AS module, upper(gene) AS gene FROM gene_panel WHERE panel IS NOT NULL), gp AS (SELECT module, gene, mean, sd FROM pg JOIN gm USING (gene) WHERE sd > 0), ps AS (SELECT module, count(*) AS k, sum(mean / sd) AS base FROM gp GROUP BY module),
sc AS (SELECT cell, module, (coalesce(sum(n / sd), 0) - any_value(base)) / any_value(k) AS score FROM (SELECT DISTINCT cell FROM m) JOIN ps ON true LEFT JOIN (SELECT m.cell AS c2, m.n, gp.module AS m2, gp.sd FROM m JOIN gp USING (gene)) h ON h.c2 = cell AND h.m2 = module GROUP BY cell, module)"""


def panel_scores(s, d):
    """(cell, module, score): mean standardised counts over the genes of each panel (numbered by name), for every cell."""
    m = cut(counts(s, d))
    panel = table(s, d, "gene_panel").where("panel IS NOT NULL").select(F.upper("gene").alias("gene"), (F.dense_rank().over(Window.orderBy("panel")) - 1).alias("module")).distinct()  # the fixed panel
    return module_scores(m, panel)


q("module_categories", _GM + ", " + _PANEL + ", " + CELLS + """, ep AS (SELECT id, max(score) FILTER (module = (SELECT min(module) FROM ps)) AS first, max(score) FILTER (module = (SELECT max(module) FROM ps)) AS last FROM cells JOIN sc ON cell = vendor_id WHERE object = '10x_cell' AND l2 = 'Epithelial' GROUP BY id),
e1 AS (SELECT quantile_cont(round(first, 6), 0.75) AS a FROM ep), e2 AS (SELECT quantile_cont(round(last, 6), 0.9) AS b FROM ep, e1 WHERE round(first, 6) > a)
SELECT id, CASE WHEN round(last, 6) > b AND round(first, 6) > a THEN 'second' WHEN round(first, 6) > a THEN 'first' ELSE 'other' END AS category FROM ep, e1, e2""")(lambda s, d: _categories(s, d))


def _categories(s, d):
    """Epithelial cells by the scores of two modules: above the upper quartile of the first, and among these above the ninth decile of the last."""
    sc = cut(panel_scores(s, d))
    ends = F.broadcast(sc.agg(F.min("module").alias("low"), F.max("module").alias("high")))
    own = cells(s, d).where("object = '10x_cell' AND l2 = 'Epithelial'").select("id", F.col("vendor_id").alias("cell"))
    pick = lambda c: R(F.max(F.when(F.col("module") == F.col(c), F.col("score"))))
    ep = cut(own.join(sc, "cell").crossJoin(ends).groupBy("id").agg(pick("low").alias("first"), pick("high").alias("last")))
    a = cut(tab.quantiles(ep, "first", {"a": 0.75}, []))
    above = ep.crossJoin(F.broadcast(a)).where("first > a").select("last")
    b = tab.quantiles(above, "last", {"b": 0.9}, [])
    return ep.crossJoin(F.broadcast(a)).join(F.broadcast(b)).select("id", F.when((F.col("first") > F.col("a")) & (F.col("last") > F.col("b")), "second").when(F.col("first") > F.col("a"), "first").otherwise("other").alias("category"))


# gene sets by cluster
_LEVEL = "nullif(lower(trim(regexp_replace({0}, '" + SPACE_SQL.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))), '')"
_PRELIM = _NORM + ", l AS (SELECT cell, gene, ln(1 + norm) AS x FROM nm), c AS (SELECT count(DISTINCT cell) AS c FROM l), mo AS (SELECT gene, sum(x) / any_value(c) AS mean, sqrt(greatest(0, sum(x * x) / any_value(c) - (sum(x) / any_value(c)) ** 2)) AS sd FROM l, c GROUP BY gene HAVING sd > 0)," + CELLS + f""",
st AS (SELECT DISTINCT {GENE_SQL.format("gene")} AS gene, {_LEVEL.format("level_1")} AS name FROM marker_annotations WHERE {_LEVEL.format("level_1")} IS NOT NULL), nd AS (SELECT name, gene, mean, sd FROM st JOIN mo USING (gene)),
sz AS (SELECT name, count(*) AS k, sum(mean / sd) AS base FROM nd GROUP BY name), wh AS (SELECT count(*) AS ka, sum(mean / sd) AS ba FROM mo),
cl AS (SELECT vendor_id AS cell, min(dataset || '/' || cluster) AS cluster FROM cells WHERE object = '10x_cell' AND cluster >= 0 AND vendor_id IS NOT NULL GROUP BY 1),
cc AS (SELECT cluster, count(*) AS cells FROM cl WHERE cell IN (SELECT cell FROM m) GROUP BY cluster), us AS (SELECT cluster, gene, sum(x) / any_value(sd) AS u FROM l JOIN cl USING (cell) JOIN mo USING (gene) GROUP BY ALL),
ua AS (SELECT cluster, sum(u) AS ua FROM us GROUP BY cluster), um AS (SELECT cluster, name, sum(u) AS u FROM us JOIN nd USING (gene) GROUP BY ALL),
cs AS (SELECT cluster, name, (coalesce(u, 0) / cells - base) / k - coalesce(((ua - coalesce(u, 0)) / cells - (ba - base)) / nullif(ka - k, 0), 0) AS score FROM cc JOIN ua USING (cluster) JOIN sz ON true JOIN wh ON true LEFT JOIN um USING (cluster, name))"""
q("prelim_cell_type", _PRELIM + " SELECT cell, name AS prelim FROM cl JOIN (SELECT cluster, name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 6) DESC, name) AS r FROM cs) WHERE r = 1) USING (cluster)")(
    lambda s, d: _prelim(s, d)
)


def _prelim(s, d):
    """Every clustered cell of the vendor's object with the marker set of highest mean score in its cluster."""
    values = cut(mx.log1p(mx.normalize_total(cut(counts(s, d)))).select("cell", "gene", F.col("log_norm").alias("x")))
    name = F.nullif(F.lower(F.trim(F.regexp_replace("level_1", SPACE, " "))), F.lit(""))
    sets = table(s, d, "marker_annotations").select(gene("gene").alias("gene"), name.alias("name")).dropna()
    own = cells(s, d).where("object = '10x_cell' AND cluster >= 0 AND vendor_id IS NOT NULL")
    own = cut(own.groupBy(F.col("vendor_id").alias("cell")).agg(F.min(F.concat("dataset", F.lit("/"), F.col("cluster").cast("string"))).alias("cluster")))
    scores = mk.cluster_scores(values, "x", sets, own).withColumn("score", R("score"))
    return own.join(tab.first_per(scores, ["cluster"], F.desc("score"), "name").select("cluster", F.col("name").alias("prelim")), "cluster").select("cell", "prelim")
