"""Scans, filters, projections, joins, aggregations, windows and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellwright.operators import filters as flt
from cellwright.operators import tables as tab
from cellwright.plans.base import CELLS, COUNTS, GENE_SQL, TX, TYPED, Book, cells, counts, gene, tx, typed
from cellwright.runtime import table

book = Book()
q = book.add
_TX, _M, _C = f"WITH {TX} ", f"WITH {COUNTS} ", f"WITH {CELLS} "
R = lambda c, n=6: F.round(c, n)

# scans
q("src_parquet", "SELECT dataset, count(*) AS n, count(cell_id) AS with_cell FROM labeled_transcripts GROUP BY dataset")(
    lambda s, d: table(s, d, "labeled_transcripts").groupBy("dataset").agg(F.count("*").alias("n"), F.count("cell_id").alias("with_cell"))
)
q("src_parquet_cols", "SELECT transcript_id, feature_name FROM labeled_transcripts WHERE feature_name IS NOT NULL")(
    lambda s, d: table(s, d, "labeled_transcripts").select("transcript_id", "feature_name").where("feature_name IS NOT NULL")
)
_BOX = "x_location BETWEEN 100 AND 300 AND y_location BETWEEN 200 AND 500 AND qv > 25 AND NOT isnan(qv)"
q("src_parquet_region", f"SELECT DISTINCT transcript_id, x_location, y_location, qv FROM labeled_transcripts WHERE {_BOX}")(
    lambda s, d: table(s, d, "labeled_transcripts").where(_BOX).select("transcript_id", "x_location", "y_location", "qv").distinct()
)
_ROWS = [("epithelial", "barrier"), ("immune", "defence"), ("stromal", "support")]
q("src_inline", f"SELECT DISTINCT m.marker_id, m.compartment, coalesce(v.role, 'other') AS role FROM marker_annotations m LEFT JOIN (VALUES {', '.join(map(str, _ROWS))}) v(compartment, role) ON v.compartment = lower(trim(m.compartment))")(
    lambda s, d: table(s, d, "marker_annotations").select("marker_id", "compartment", F.lower(F.trim("compartment")).alias("k")).join(s.createDataFrame(_ROWS, "k string, role string"), "k", "left").select("marker_id", "compartment", F.coalesce("role", F.lit("other")).alias("role")).distinct()
)

# filters
_PRE = " OR ".join(f"starts_with(feature_name, '{p}')" for p in "NegControlProbe_ antisense_ NegControlCodeword_ BLANK_ DeprecatedCodeword_ UnassignedCodeword_".split())
q("filter_transcripts", f"SELECT DISTINCT transcript_id, feature_name, qv FROM labeled_transcripts WHERE qv >= 30 AND NOT isnan(qv) AND NOT ({_PRE})")(
    lambda s, d: flt.filter_transcripts(table(s, d, "labeled_transcripts")).select("transcript_id", "feature_name", "qv").distinct()
)
q("filter_transcripts_ext", "SELECT DISTINCT transcript_id, feature_name FROM labeled_transcripts WHERE qv >= 25 AND NOT isnan(qv) AND NOT (contains(feature_name, 'BLANK') OR contains(feature_name, 'antisense'))")(
    lambda s, d: flt.filter_containing(table(s, d, "labeled_transcripts"), "feature_name", ["BLANK", "antisense"], "qv", 25).select("transcript_id", "feature_name").distinct()
)
q("filter_score", _TX + "SELECT id, b, score FROM tx WHERE score > 0.75")(lambda s, d: tx(s, d, "b", "score").where("score > 0.75").select("id", "b", "score"))
q("mask_low_score", _TX + "SELECT id, CASE WHEN score < 0.5 THEN NULL ELSE b END AS b, score FROM tx")(
    lambda s, d: tx(s, d, "b", "score").select("id", F.when(F.col("score") < 0.5, None).otherwise(F.col("b")).alias("b"), "score")
)
q("filter_not_null", _TX + "SELECT id, a, b FROM tx WHERE a IS NOT NULL AND b IS NOT NULL")(lambda s, d: tx(s, d, "a", "b").dropna(subset=["a", "b"]).select("id", "a", "b"))
q("filter_between", _TX + "SELECT id, x BETWEEN 100 AND 200 AS inside FROM tx WHERE y NOT BETWEEN 150 AND 400")(
    lambda s, d: tx(s, d, "x", "y").where(~F.col("y").between(150, 400)).select("id", F.col("x").between(100, 200).alias("inside"))
)
q("filter_isin", _TX + "SELECT id, gene FROM tx WHERE gene IN (SELECT upper(gene) FROM gene_panel WHERE panel_order <= 40)")(
    lambda s, d: tx(s, d, "gene").select("id", "gene").join(table(s, d, "gene_panel").where("panel_order <= 40").select(F.upper("gene").alias("gene")), "gene", "left_semi")
)
q("filter_not_isin", _TX + "SELECT id, gene FROM tx WHERE gene IS NOT NULL AND gene NOT IN (SELECT upper(gene) FROM gene_panel)")(
    lambda s, d: tx(s, d, "gene").where("gene IS NOT NULL").select("id", "gene").join(table(s, d, "gene_panel").select(F.upper("gene").alias("gene")), "gene", "left_anti")
)
q("filter_group_mask", _TX + ", ok AS (SELECT a FROM tx WHERE a IS NOT NULL GROUP BY a HAVING avg(CAST(pos AS DOUBLE)) > 0.33 AND count(*) > 10) SELECT id, a FROM tx WHERE a IN (SELECT a FROM ok)")(
    lambda s, d: flt.filter_group(tx(s, d, "a", "pos").where("a IS NOT NULL").select("id", "a", "pos"), "a", (F.avg(F.col("pos").cast("double")) > 0.33) & (F.count("*") > 10)).select("id", "a")
)
q("filter_min_counts", _M + "SELECT * FROM m WHERE cell IN (SELECT cell FROM m GROUP BY cell HAVING sum(n) BETWEEN 5 AND 2000)")(lambda s, d: flt.filter_total(counts(s, d), "cell", 5, 2000))
q("filter_genes", _M + "SELECT * FROM m WHERE gene IN (SELECT gene FROM m GROUP BY gene HAVING sum(n) >= 10)")(lambda s, d: flt.filter_total(counts(s, d), "gene", 10))
q("filter_bytype", _C + "SELECT id, dataset, l1 FROM cells WHERE l2 = 'Immune' AND dataset IN ('xenium_colon_000', 'xenium_nsclc_001')")(
    lambda s, d: cells(s, d).where((F.col("l2") == "Immune") & F.col("dataset").isin("xenium_colon_000", "xenium_nsclc_001")).select("id", "dataset", "l1")
)
_TOT = "t AS (SELECT cell, sum(n)::BIGINT AS n FROM m GROUP BY cell)"
q("filter_split_counts", _M + f", {_TOT} SELECT 'lt' AS part, cell, n FROM t WHERE n < 25 UNION ALL SELECT 'gt', cell, n FROM t WHERE n > 25")(
    lambda s, d: counts(s, d).groupBy("cell").agg(F.sum("n").alias("n")).where("n <> 25").select(F.when(F.col("n") < 25, "lt").otherwise("gt").alias("part"), "cell", "n")
)

# projections
q("proj_rename", _C + "SELECT id AS obs, label AS celltype FROM cells")(lambda s, d: cells(s, d).select("id", "label").withColumnsRenamed({"id": "obs", "label": "celltype"}))
q("proj_case", _C + "SELECT id, CASE WHEN prob < 0.5 THEN 'Uncertain' WHEN l2 = 'Immune' THEN 'Immune' WHEN cluster = -1 THEN 'None' ELSE label END AS kind FROM cells")(
    lambda s, d: cells(s, d).select("id", tab.case_last_wins([(F.col("cluster") == -1, "None"), (F.col("l2") == "Immune", "Immune"), (F.col("prob") < 0.5, "Uncertain")], F.col("label")).alias("kind"))
)
q("proj_map", _C + "SELECT c.id, t.compartment FROM cells c LEFT JOIN (SELECT lower(name) AS name, compartment FROM cell_types) t ON t.name = c.label")(
    lambda s, d: cells(s, d).select("id", F.col("label").alias("name")).join(table(s, d, "cell_types").select(F.lower("name").alias("name"), "compartment"), "name", "left").select("id", "compartment")
)
q("proj_invert_map", "SELECT DISTINCT marker_id, i.cell_type_id FROM marker_annotations m JOIN (SELECT cell_type_id, lower(unnest(aliases)) AS alias FROM cell_types) i ON i.alias = lower(trim(m.label))")(
    lambda s, d: table(s, d, "marker_annotations").select("marker_id", F.lower(F.trim("label")).alias("alias")).join(table(s, d, "cell_types").select("cell_type_id", F.explode(F.transform("aliases", F.lower)).alias("alias")), "alias").select("marker_id", "cell_type_id").distinct()
)
q("proj_fillna", _C + "SELECT id, coalesce(label, 'Unknown') AS label FROM cells")(lambda s, d: cells(s, d).select("id", "label").fillna({"label": "Unknown"}))
q("proj_cast", _C + "SELECT id, CAST(cluster AS VARCHAR) AS cluster, CAST(n_counts AS DOUBLE) AS counts, n_counts > 20 AS big FROM cells")(
    lambda s, d: cells(s, d).select("id", F.col("cluster").cast("string").alias("cluster"), F.col("n_counts").cast("double").alias("counts"), (F.col("n_counts") > 20).alias("big"))
)
q("proj_clip_rescale", _C + "SELECT id, round((least(greatest(prob, 0.2), 0.9) - 0.2) / 0.7, 6) AS scaled FROM cells WHERE prob IS NOT NULL AND NOT isnan(prob)")(
    lambda s, d: cells(s, d).where("prob IS NOT NULL AND NOT isnan(prob)").select("id", R((F.least(F.greatest("prob", F.lit(0.2)), F.lit(0.9)) - 0.2) / 0.7).alias("scaled"))
)


def _edges(df, value, qs):
    return F.broadcast(df.agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("e")))  # one row


q("proj_bin_quantile", _C + ", e AS (SELECT quantile_cont(n_counts, [0.0, 0.25, 1.0]) AS e FROM cells) SELECT id, n_counts, CASE WHEN n_counts > e[1] AND n_counts <= e[2] THEN 0 WHEN n_counts > e[2] AND n_counts <= e[3] THEN 1 END AS bin FROM cells, e")(
    lambda s, d: (lambda c: c.crossJoin(_edges(c, "n_counts", [0.0, 0.25, 1.0])).select("id", "n_counts", tab.quantile_bin(F.col("n_counts"), F.col("e"), 3).alias("bin")))(cells(s, d).select("id", "n_counts"))
)
q("proj_bin_equal", _M + f", {_TOT}, l AS (SELECT cell, log10(n) AS l FROM t), r AS (SELECT min(l) AS a, max(l) AS b FROM l) SELECT cell, CAST(least(9, floor(round((l - a) / (b - a) * 10, 9))) AS BIGINT) AS bin FROM l, r")(
    lambda s, d: (lambda t: t.crossJoin(F.broadcast(t.agg(F.min("l").alias("a"), F.max("l").alias("b")))).select("cell", F.least(F.lit(9).cast("bigint"), F.floor(F.round((F.col("l") - F.col("a")) / (F.col("b") - F.col("a")) * 10, 9))).alias("bin")))(
        counts(s, d).groupBy("cell").agg(F.log10(F.sum("n")).alias("l"))
    )
)
q("proj_encode", _C + ", k AS (SELECT label, 2 * (row_number() OVER (ORDER BY label) - 1) AS code FROM (SELECT DISTINCT label FROM cells WHERE label IS NOT NULL)) SELECT id, code, round((code + prob) / (SELECT max(code) + 1 FROM k), 6) AS position FROM cells JOIN k USING (label) WHERE prob IS NOT NULL AND NOT isnan(prob)")(
    lambda s, d: (
        lambda c: (lambda k: c.where("prob IS NOT NULL AND NOT isnan(prob)").join(k, "label").crossJoin(F.broadcast(k.agg((F.max("code") + 1).alias("top")))).select("id", "code", R((F.col("code") + F.col("prob")) / F.col("top")).alias("position")))(
            c.where("label IS NOT NULL").select("label").distinct().withColumn("code", (2 * (F.row_number().over(Window.orderBy("label")) - 1)).cast("bigint"))  # one row per label
        )
    )(cells(s, d).select("id", "label", "prob"))
)
q("proj_factorize", _C + ", k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM cells WHERE label IS NOT NULL)) SELECT c.id, k.code FROM cells c LEFT JOIN k ON k.label = c.label")(
    lambda s, d: (lambda c: c.join(c.where("label IS NOT NULL").select("label").distinct().withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint")), "label", "left").select("id", "code"))(cells(s, d).select("id", "label"))
)
q("proj_negate", _C + "SELECT id, -entropy AS entropy FROM cells")(lambda s, d: cells(s, d).select("id", (-F.col("entropy")).alias("entropy")))

# joins
q("join_inner_index", _M + f", {_TOT}, c AS (SELECT a AS cell, avg(CAST(pos AS DOUBLE)) AS nuclear FROM tx WHERE a IS NOT NULL GROUP BY a) SELECT cell, n, nuclear FROM t JOIN c USING (cell)")(
    lambda s, d: counts(s, d).groupBy("cell").agg(F.sum("n").alias("n")).join(tx(s, d, "a", "pos").where("a IS NOT NULL").groupBy(F.col("a").alias("cell")).agg(F.avg(F.col("pos").cast("double")).alias("nuclear")), "cell")
)
q("join_left_lookup", f"WITH {TX}, {TYPED} SELECT tx.id, typed.type FROM tx LEFT JOIN typed ON typed.cell = tx.a")(
    lambda s, d: tx(s, d, "a").select("id", F.col("a").alias("cell")).join(typed(s, d), "cell", "left").select("id", "type")
)
q("join_align_div", _TX + ", g AS (SELECT gene, count(*) AS n FROM tx WHERE gene IS NOT NULL GROUP BY gene), h AS (SELECT gene, count(*) AS k FROM tx WHERE gene IS NOT NULL AND b IS NOT NULL GROUP BY gene) SELECT gene, coalesce(CAST(k AS DOUBLE) / n, 0) AS share FROM g FULL JOIN h USING (gene)")(
    lambda s, d: (lambda t: t.groupBy("gene").agg(F.count("*").alias("n")).join(t.where("b IS NOT NULL").groupBy("gene").agg(F.count("*").alias("k")), "gene", "full").select("gene", F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("n")), F.lit(0.0)).alias("share")))(
        tx(s, d, "gene", "b").where("gene IS NOT NULL").select("gene", "b")
    )
)
q("join_reindex", _M + "SELECT p.gene, coalesce(sum(n), 0)::BIGINT AS n FROM gene_panel p LEFT JOIN m ON m.gene = upper(p.gene) GROUP BY p.gene")(
    lambda s, d: table(s, d, "gene_panel").select("gene", F.upper("gene").alias("k")).join(counts(s, d).groupBy(F.col("gene").alias("k")).agg(F.sum("n").alias("n")), "k", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n"))
)
q("join_semi", f"WITH {CELLS} SELECT id FROM cells WHERE object = 'segger' AND vendor_id IN (SELECT vendor_id FROM cells WHERE object = '10x_cell')")(
    lambda s, d: cells(s, d).where("object = 'segger'").join(cells(s, d).where("object = '10x_cell'").select("vendor_id"), "vendor_id", "left_semi").select("id")
)
q("join_anti", _C + "SELECT id FROM cells c WHERE object = '10x_cell' AND NOT EXISTS (SELECT 1 FROM cells o WHERE o.object = '10x_nucleus' AND o.vendor_id = c.vendor_id)")(
    lambda s, d: cells(s, d).where("object = '10x_cell'").join(cells(s, d).where("object = '10x_nucleus'").select("vendor_id"), "vendor_id", "left_anti").select("id")
)
q("join_gene_intersect", f"WITH {COUNTS} SELECT * FROM m WHERE gene IN (SELECT {GENE_SQL.format('gene')} FROM marker_annotations)")(
    lambda s, d: counts(s, d).join(table(s, d, "marker_annotations").select(gene("gene").alias("gene")).distinct(), "gene", "left_semi").select("cell", "gene", "n")
)
_BOXES = [(0, 50, 250, 50, 400), (1, 200, 420, 300, 600), (2, 400, 700, 100, 900)]
q("join_point_in_box", _TX + f"SELECT id, coalesce(max(box), -1) AS box FROM tx LEFT JOIN (VALUES {', '.join(map(str, _BOXES))}) v(box, x0, x1, y0, y1) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id")(
    lambda s, d: tx(s, d, "x", "y").select("id", tab.case_last_wins([(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), F.lit(b)) for b, x0, x1, y0, y1 in _BOXES], F.lit(-1)).alias("box"))
)
q("join_argmax_lookup", f"WITH {TX}, {CELLS}, ab AS (SELECT b, a, count(*) AS n FROM tx WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY b, a), best AS (SELECT b, a, n FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS r FROM ab) WHERE r = 1), na AS (SELECT a, count(*) AS total FROM tx WHERE a IS NOT NULL GROUP BY a) SELECT b AS cell, a AS partner, n, total FROM best JOIN na USING (a)")(
    lambda s, d: (lambda t: tab.argmax_partner(t, "b", "a").join(t.where("a IS NOT NULL").groupBy("a").agg(F.count("*").alias("total")), "a").select(F.col("b").alias("cell"), F.col("a").alias("partner"), "n", "total"))(tx(s, d, "a", "b").select("a", "b"))
)
q("join_concat_index", _C + "SELECT c.vendor_id AS cell, min(c.n_counts) AS vendor, min(n.n_counts) AS nucleus FROM cells c JOIN cells n ON n.vendor_id = c.vendor_id AND n.object = '10x_nucleus' WHERE c.object = '10x_cell' GROUP BY 1")(
    lambda s, d: (lambda o: o("10x_cell", "vendor").join(o("10x_nucleus", "nucleus"), "cell"))(lambda k, n: cells(s, d).where(F.col("object") == k).where("vendor_id IS NOT NULL").groupBy(F.col("vendor_id").alias("cell")).agg(F.min("n_counts").alias(n)))
)

# aggregations
q("agg_cell_gene", _M + "SELECT cell, gene, n FROM m")(counts)
_PIV = ["10x_cell", "10x_nucleus", "segger"]
q("agg_pivot", _C + "SELECT cluster, " + ", ".join(f"count(*) FILTER (object = '{o}') AS n_{o}" for o in _PIV) + " FROM cells WHERE cluster IS NOT NULL GROUP BY cluster")(
    lambda s, d: cells(s, d).where("cluster IS NOT NULL").groupBy("cluster").pivot("object", _PIV).count().fillna(0).withColumnsRenamed({o: f"n_{o}" for o in _PIV})
)
q("agg_unpivot", _C + "SELECT id, 'prob' AS measure, prob AS value FROM cells UNION ALL SELECT id, 'entropy', entropy FROM cells")(
    lambda s, d: cells(s, d).unpivot("id", ["prob", "entropy"], "measure", "value")
)
q("agg_totals", _M + "SELECT cell, sum(n)::BIGINT AS transcripts, count(*) AS genes FROM m GROUP BY cell")(lambda s, d: counts(s, d).groupBy("cell").agg(F.sum("n").alias("transcripts"), F.count("*").alias("genes")))
q("agg_value_counts", _C + "SELECT label, object, count(*) AS n FROM cells WHERE label IS NOT NULL AND object IS NOT NULL GROUP BY label, object")(lambda s, d: cells(s, d).dropna(subset=["label", "object"]).groupBy("label", "object").agg(F.count("*").alias("n")))
q("agg_mean_bool", _TX + "SELECT a AS cell, avg(CAST(pos AS DOUBLE)) AS share FROM tx WHERE a IS NOT NULL GROUP BY a")(lambda s, d: tx(s, d, "a", "pos").where("a IS NOT NULL").groupBy(F.col("a").alias("cell")).agg(F.avg(F.col("pos").cast("double")).alias("share")))
q("agg_fraction", _C + "SELECT avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS confident FROM cells")(lambda s, d: cells(s, d).agg(F.avg(F.when(F.col("prob") >= 0.5, 1.0).otherwise(0.0)).alias("confident")))
q("agg_size_max_sum", _TX + "SELECT dataset, count(*) AS size, max(qv) AS best, sum(pos)::BIGINT AS nuclear FROM tx GROUP BY dataset")(lambda s, d: tx(s, d, "dataset", "qv", "pos").groupBy("dataset").agg(F.count("*").alias("size"), F.max("qv").alias("best"), F.sum("pos").alias("nuclear")))
_ROW = "greatest(CAST(n AS DOUBLE), k, u)"
_SH = _TX + ", w AS (SELECT a AS cell, count(*) FILTER (pos = 1) AS n, count(*) FILTER (pos = 0) AS k, count(*) FILTER (b IS NULL) AS u FROM tx WHERE a IS NOT NULL GROUP BY a) "
q("agg_idxmax_row", _SH + f"SELECT cell, CASE {_ROW} WHEN n THEN 'nuclear' WHEN k THEN 'cytoplasmic' ELSE 'unmatched' END AS most FROM w")(
    lambda s, d: (lambda w: w.select("cell", F.when((F.col("n") >= F.col("k")) & (F.col("n") >= F.col("u")), "nuclear").when(F.col("k") >= F.col("u"), "cytoplasmic").otherwise("unmatched").alias("most")))(
        tx(s, d, "a", "pos", "b").where("a IS NOT NULL").groupBy(F.col("a").alias("cell")).agg(F.count_if(F.expr("pos = 1")).alias("n"), F.count_if(F.expr("pos = 0")).alias("k"), F.count_if(F.expr("b IS NULL")).alias("u"))
    )
)
q("agg_mode_label", _C + ", n AS (SELECT cluster, l1, count(*) AS n FROM cells WHERE cluster IS NOT NULL AND l1 IS NOT NULL GROUP BY ALL) SELECT cluster, l1, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, l1) AS r FROM n) WHERE r = 1")(
    lambda s, d: tab.argmax_partner(cells(s, d), "cluster", "l1")
)
q("agg_nunique", _TX + "SELECT dataset, count(DISTINCT gene) AS genes, count(DISTINCT a) AS cells FROM tx GROUP BY dataset")(lambda s, d: tx(s, d, "dataset", "gene", "a").groupBy("dataset").agg(F.count_distinct("gene").alias("genes"), F.count_distinct("a").alias("cells")))
q("agg_centroid", _TX + "SELECT a AS cell, sum(CAST(round(x * 10000) AS BIGINT))::DOUBLE / (count(*) * 10000.0::DOUBLE) AS x, sum(CAST(round(y * 10000) AS BIGINT))::DOUBLE / (count(*) * 10000.0::DOUBLE) AS y FROM tx WHERE a IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY a")(
    lambda s, d: tx(s, d, "a", "x", "y").dropna(subset=["a", "x", "y"]).groupBy(F.col("a").alias("cell")).agg(*((F.sum(F.round(F.col(c) * 10000).cast("bigint")).cast("double") / (F.count("*") * 10000.0)).alias(c) for c in "xy"))  # whole tenths of nm: sums don't depend on their order
)
q("agg_percent_assigned", _TX + ", g AS (SELECT gene, count(*) AS n, count(a) AS k FROM tx WHERE gene IS NOT NULL GROUP BY gene) SELECT gene, 100.0::DOUBLE * k / n AS percent FROM g UNION ALL SELECT '*', 100.0::DOUBLE * sum(k)::BIGINT / sum(n)::BIGINT FROM g")(
    lambda s, d: (lambda g: g.select("gene", (100.0 * F.col("k") / F.col("n")).alias("percent")).unionByName(g.agg((100.0 * F.sum("k") / F.sum("n")).alias("percent")).select(F.lit("*").alias("gene"), "percent")))(
        tx(s, d, "gene", "a").where("gene IS NOT NULL").groupBy("gene").agg(F.count("*").alias("n"), F.count("a").alias("k"))
    )
)
q("agg_quantile", _C + "SELECT object, quantile_cont(n_counts, 0.05) AS q05, quantile_cont(n_counts, 0.5) AS q50, quantile_cont(n_counts, 0.9) AS q90 FROM cells GROUP BY object")(
    lambda s, d: cells(s, d).groupBy("object").agg(*(F.percentile("n_counts", p).alias(n) for n, p in (("q05", 0.05), ("q50", 0.5), ("q90", 0.9))))
)
q("agg_matrix", f"WITH {COUNTS}, {TYPED}, k AS (SELECT type, count(*) AS c FROM typed WHERE cell IN (SELECT cell FROM m) GROUP BY type) SELECT type, gene, round(sum(n)::DOUBLE / any_value(c), 6) AS mean, sum(n)::BIGINT AS total FROM m JOIN typed USING (cell) JOIN k USING (type) GROUP BY type, gene")(
    lambda s, d: (lambda mt: mt.groupBy("type", "gene").agg(F.sum("n").alias("total")).join(mt.groupBy("type").agg(F.count_distinct("cell").alias("c")), "type").select("type", "gene", R(F.col("total") / F.col("c")).alias("mean"), "total"))(counts(s, d).join(typed(s, d), "cell"))
)
q("agg_hist_log", _M + f", {_TOT} SELECT CAST(least(48, floor(log10(n) * 49 / 3)) AS BIGINT) AS bin, count(*) AS cells FROM t WHERE n BETWEEN 1 AND 1000 GROUP BY 1")(
    lambda s, d: counts(s, d).groupBy("cell").agg(F.sum("n").alias("n")).where("n BETWEEN 1 AND 1000").groupBy(F.least(F.lit(48).cast("bigint"), F.floor(F.log10("n") * 49 / 3)).alias("bin")).agg(F.count("*").alias("cells"))
)
q("agg_barplot_pi", _C + "SELECT object, round(avg(n_counts), 6) AS mean, quantile_cont(n_counts, 0.25) AS low, quantile_cont(n_counts, 0.75) AS high FROM cells GROUP BY object")(
    lambda s, d: cells(s, d).groupBy("object").agg(R(F.avg("n_counts")).alias("mean"), F.percentile("n_counts", 0.25).alias("low"), F.percentile("n_counts", 0.75).alias("high"))
)
q("agg_boxplot", _C + "SELECT n_counts >= 20 AS big, round(quantile_cont(prob, 0.25), 6) AS q1, round(quantile_cont(prob, 0.5), 6) AS q2, round(quantile_cont(prob, 0.75), 6) AS q3 FROM cells WHERE prob IS NOT NULL AND NOT isnan(prob) AND n_counts IS NOT NULL GROUP BY 1")(
    lambda s, d: tab.quantiles(cells(s, d).where("prob IS NOT NULL AND NOT isnan(prob) AND n_counts IS NOT NULL").select((F.col("n_counts") >= 20).alias("big"), "prob"), "prob", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["big"]).select("big", *(R(c).alias(c) for c in ("q1", "q2", "q3")))
)

# windows and ranking
q("win_cumsum", _C + ", k AS (SELECT label, count(*) AS n FROM cells WHERE label IS NOT NULL GROUP BY label) SELECT label, n, sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM k")(
    lambda s, d: cells(s, d).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, 0)))  # one row per label
)
q("win_first_per_group", _C + "SELECT dataset, label, id, prob FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY prob DESC, id) AS r FROM cells WHERE label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob)) WHERE r = 1")(
    lambda s, d: tab.first_per(cells(s, d).where("label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob)"), ["dataset", "label"], F.desc("prob"), "id").select("dataset", "label", "id", "prob")
)
q("win_rank_size", _C + ", k AS (SELECT dataset, cluster, count(*) AS n FROM cells WHERE cluster >= 0 GROUP BY ALL) SELECT dataset, cluster, n, CASE WHEN n <= 20 THEN -1 ELSE row_number() OVER (PARTITION BY dataset ORDER BY n DESC, cluster) - 1 END AS label FROM k")(
    lambda s, d: cells(s, d).where("cluster >= 0").groupBy("dataset", "cluster").agg(F.count("*").alias("n")).select("dataset", "cluster", "n", F.when(F.col("n") <= 20, -1).otherwise(F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "cluster")) - 1).cast("bigint").alias("label"))
)
q("win_rank_avg", _C + ", v AS (SELECT object, n_counts, count(*) AS k FROM cells WHERE n_counts IS NOT NULL GROUP BY ALL), r AS (SELECT object, n_counts, sum(k) OVER (PARTITION BY object ORDER BY n_counts)::BIGINT - (k - 1) / 2.0::DOUBLE AS rank FROM v) SELECT id, rank FROM cells JOIN r USING (object, n_counts)")(
    lambda s, d: tab.average_rank(cells(s, d).where("n_counts IS NOT NULL").select("id", "object", "n_counts"), "n_counts", ["object"], "rank").select("id", "rank")
)
q("topk_nlargest", _C + "SELECT object, id, n_counts FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY n_counts DESC, id) AS r FROM cells WHERE n_counts IS NOT NULL) WHERE r <= 20")(
    lambda s, d: cells(s, d).where("n_counts IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("object").orderBy(F.desc("n_counts"), "id"))).where("r <= 20").select("object", "id", "n_counts")
)
q("sort", _C + "SELECT id, n_counts FROM cells ORDER BY n_counts DESC NULLS LAST, id")(lambda s, d: cells(s, d).select("id", "n_counts").orderBy(F.desc_nulls_last("n_counts"), "id"))

# set operations
_LAB = "SELECT label FROM cells WHERE dataset = '{0}' AND label IS NOT NULL"
_ab = lambda s, d: (cells(s, d).where("dataset = 'xenium_colon_000' AND label IS NOT NULL").select("label"), cells(s, d).where("dataset = 'xenium_nsclc_001' AND label IS NOT NULL").select("label"))
_A, _B = _LAB.format("xenium_colon_000"), _LAB.format("xenium_nsclc_001")
q("set_intersect", _C + f"{_A} INTERSECT {_B}")(lambda s, d: (lambda a, b: a.intersect(b))(*_ab(s, d)))
q("set_except", _C + f"{_A} EXCEPT {_B}")(lambda s, d: (lambda a, b: a.subtract(b))(*_ab(s, d)))
q("set_union_distinct", _C + f"{_A} UNION {_B}")(lambda s, d: (lambda a, b: a.union(b).distinct())(*_ab(s, d)))
q("set_union_all", _C + f"{_A} UNION ALL {_B}")(lambda s, d: (lambda a, b: a.unionByName(b))(*_ab(s, d)))
q("set_dedup", "SELECT DISTINCT gene, label, compartment FROM marker_annotations")(lambda s, d: table(s, d, "marker_annotations").select("gene", "label", "compartment").dropDuplicates())
q("set_union_inner", "SELECT gene FROM gene_panel UNION ALL SELECT gene FROM marker_annotations")(lambda s, d: tab.union_common(table(s, d, "gene_panel"), table(s, d, "marker_annotations")))
