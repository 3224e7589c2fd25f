"""Sources and sinks, models, and whole pipelines over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import differential, ordering
from cellwright.operators import geometry as geo
from cellwright.operators import markers as mk
from cellwright.operators import matrix as mx
from cellwright.operators import models
from cellwright.operators import tables as tab
from cellwright.operators.components import nearest, on_axes, principal_axes
from cellwright.operators.filters import filter_total
from cellwright.operators.graph import near_clusters
from cellwright.operators.layout import plane
from cellwright.plans.base import CELLS, COUNTS, SPACE_SQL, TX, Book, cells, counts, tx, typed
from cellwright.plans.basic import R
from cellwright.plans.spatial import _AREA, _pt, placed, rings
from cellwright.runtime import cut, scratch, table
from cellwright.sources import store

book = Book()
q = book.add


@q("sink_csv", f"WITH {CELLS} SELECT id, object, n_counts FROM cells WHERE n_counts IS NOT NULL AND object IS NOT NULL")
def csv_round_trip(s, d):
    path = scratch(s)
    store.write_csv(cells(s, d).where("n_counts IS NOT NULL AND object IS NOT NULL").select("id", "object", "label", "n_counts"), path)
    return store.read_csv(s, path, "id bigint, object string, label string, n_counts int", [0, 1, 3])


@q("sink_h5ad", f"WITH {COUNTS} SELECT g.gene, count(*) AS cells, sum(n)::BIGINT AS n FROM m g GROUP BY g.gene")
def matrix_round_trip(s, d):
    path, m = scratch(s), counts(s, d)
    store.write_matrix(path, counts=m, cells=mx.totals(m))
    return store.read_matrix(s, path, "counts")["counts"].groupBy("gene").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


@q("src_geoparquet", _AREA + " SELECT dataset, cell_id, round(area, 4) AS area FROM ar")
def polygons_round_trip(s, d):
    path = scratch(s)
    rings(s, d).select("dataset", "cell_id", store.to_wkb("xs", "ys").alias("geometry")).write.parquet(path)
    back = s.read.parquet(path).withColumn("ring", store.from_wkb("geometry"))
    xy = back.select("dataset", "cell_id", F.transform("ring", lambda p: p[0]).alias("xs"), F.transform("ring", lambda p: p[1]).alias("ys"))
    return xy.select("dataset", "cell_id", R(geo.shoelace("xs", "ys"), 4).alias("area"))


@q("src_csv", f"WITH {CELLS} SELECT id, label FROM cells WHERE label IS NOT NULL")
def csv_by_position(s, d):
    path = scratch(s)
    store.write_csv(cells(s, d).where("label IS NOT NULL").select("object", "label", "n_counts", "id"), path)
    return store.read_csv(s, path, "object string, label string, n_counts int, id bigint", [3, 1])


@q("src_json", f"WITH {CELLS} SELECT id, label, n_counts FROM cells")
def json_round_trip(s, d):
    path = scratch(s)
    cells(s, d).select("id", "label", "n_counts").write.json(path)
    return s.read.schema("id bigint, label string, n_counts int").json(path)


q("proj_colregex", "SELECT DISTINCT obs_id, COLUMNS('cell_type.*') FROM h5ads WHERE obs_id IS NOT NULL")(
    lambda s, d: (lambda t: t.where("obs_id IS NOT NULL").select("obs_id", t.colRegex("`cell_type.*`")).distinct())(table(s, d, "h5ads"))
)


@q("deseq2")
def deseq2(s, d):
    """The most frequent type against all others, six pseudobulk samples each, dealt by a hash of the cell."""
    t = cut(typed(s, d))
    first = t.groupBy("type").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "type").limit(1).select("type", F.lit(1).alias("is_first"))
    dealt = t.join(F.broadcast(first), "type", "left").select("cell", F.coalesce("is_first", F.lit(0)).alias("condition"), F.pmod(F.xxhash64("cell"), F.lit(6)).alias("i"))
    m = counts(s, d).join(dealt, "cell").groupBy((F.col("condition") * 6 + F.col("i")).alias("sample"), "gene").agg(F.sum("n").alias("n"))
    samples = dealt.select((F.col("condition") * 6 + F.col("i")).alias("sample"), "condition").distinct()
    return differential.negative_binomial_test(m, samples)


def _type_means(m, types):
    tg = mk.type_gene(m, types)
    return cut(tg.select("type", "gene", (F.col("total").cast("double") / F.col("cells")).alias("mean")))


@q("color_order")
def color_order(s, d):
    """Types on a line from 0 to 1: leaf order of the correlations of their mean profiles."""
    tm = _type_means(counts(s, d), typed(s, d))
    side = lambda k: tm.select("gene", F.col("type").alias(f"g{k}"), F.col("mean").alias(f"m{k}"))
    r = side(1).join(side(2), "gene").where("g1 <= g2").groupBy("g1", "g2").agg(F.corr("m1", "m2").alias("r"))  # types by types
    return ordering.leaf_positions(r).withColumnRenamed("thing", "type")


@q("corr_order")
def corr_order(s, d):
    """All genes, grouped by the type that has their highest mean, in the order of their correlations."""
    m = cut(counts(s, d))
    best = _type_means(m, typed(s, d)).groupBy("gene").agg(F.max_by("type", F.struct("mean", "type")).alias("label"))
    return ordering.place_blocks(*mx.correlation_blocks(m, "n", best))


@q("pca")
def pca(s, d):
    return models.project(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))[0]


def _genes(m):
    """The vocabulary of the matrix: the panel and its strays."""
    return [r.gene for r in m.select("gene").distinct().orderBy("gene").collect()]


@q("celltypist_train")
def celltypist(s, d):
    """Train on the typed cells over all genes, save, load, and predict every cell of the vendor's matrix."""
    m = cut(counts(s, d))
    genes = _genes(m)
    model, labels = models.train_annotator(m, cut(typed(s, d)), genes)
    path = scratch(s)
    model.write().overwrite().save(path)
    return models.annotate(models.PipelineModel.load(path), labels, m, genes)


@q("label_transfer")
def label_transfer(s, d):
    """Types of one half of the cells (by a hash), given to the other half by neighbours over their common genes."""
    m, t = cut(counts(s, d)), cut(typed(s, d))
    from_ref = F.pmod(F.xxhash64("cell"), F.lit(2)) == 0
    ref, query = m.where(from_ref), m.where(~from_ref)
    genes = _genes(ref.join(query.select("gene").distinct(), "gene", "left_semi"))
    return models.transfer_labels(ref, t, filter_total(query, "cell", 5), genes)


q("sample_group", None)(lambda s, d: models.sample_per(typed(s, d), "type", "cell", 50))
q("sample_cap")(lambda s, d: cells(s, d).select("id", "object", "cluster").orderBy(F.xxhash64("id"), "id").limit(10_000))


@q("create_anndata", f"""WITH {COUNTS}, t AS (SELECT cell FROM m GROUP BY cell HAVING sum(n) BETWEEN 5 AND 2000), k AS (SELECT * FROM m WHERE cell IN (SELECT cell FROM t)),
c AS (SELECT cell, sum(n)::BIGINT AS transcripts, count(*) AS genes FROM k GROUP BY cell), x AS (SELECT a AS cell, count(x) AS located FROM tx WHERE a IS NOT NULL AND y IS NOT NULL GROUP BY a) SELECT c.cell, transcripts, genes, located FROM c JOIN x USING (cell)""")
def create_anndata(s, d):
    """Cells of 5 to 2000 molecules with their totals and the number of located ones."""
    k = filter_total(counts(s, d), "cell", 5, 2000).groupBy("cell").agg(F.sum("n").alias("transcripts"), F.count("*").alias("genes"))
    x = tx(s, d, "a", "x", "y").where("a IS NOT NULL AND y IS NOT NULL").groupBy(F.col("a").alias("cell")).agg(F.count("x").alias("located"))
    return k.join(x, "cell")


_FILTERED = f"""WITH {COUNTS}, t AS (SELECT cell FROM m GROUP BY cell HAVING sum(n) BETWEEN 5 AND 2000)"""


@q("create_anndata_genes", _FILTERED + " SELECT gene, count(*) AS molecules, round(100.0::DOUBLE * count(*) FILTER (a IN (SELECT cell FROM t)) / count(*), 6) AS percent_assigned FROM tx WHERE gene IS NOT NULL GROUP BY gene")
def create_anndata_genes(s, d):
    """Per gene the share of its molecules that lie in kept cells."""
    t = cut(tx(s, d, "a", "gene").where("gene IS NOT NULL").groupBy("gene", F.col("a").alias("cell")).agg(F.count("*").alias("n")))
    kept = filter_total(t.where("cell IS NOT NULL"), "cell", 5, 2000).groupBy("gene").agg(F.sum("n").alias("k"))
    every = t.groupBy("gene").agg(F.sum("n").alias("molecules")).join(kept, "gene", "left")
    return every.select("gene", "molecules", R(100.0 * F.coalesce("k", F.lit(0)) / F.col("molecules")).alias("percent_assigned"))


@q("create_anndata_cells")
def create_anndata_cells(s, d):
    """Kept cells with totals and the hull of their molecules."""
    return create_anndata(s, d).join(geo.cell_hulls(_pt(s, d)), "cell")


@q("preprocess_pipeline")
def preprocess(s, d):
    """Filter at the knee of totals, normalise, log, project on components up to the knee of their variance, find neighbours,
    lay out in the plane, cluster: (cell, lognorm, umap_1, umap_2, cluster).

    As by default, components are those of the normalised counts, and a cell is the first of its own 15 neighbours.
    """
    k = 15
    m = cut(counts(s, d))
    least = mx.knee_of_totals(mx.totals(m), "total").first()
    m = cut(filter_total(m, "cell", min(max(least.value if least else 5, 5), 30)))
    number = cut(m.select("cell").distinct().withColumn("id", F.monotonically_increasing_id()))
    genes = _genes(m)
    rows = cut(models.entries(m, genes, None, log=False).join(number, "cell"))
    v = cut(on_axes(rows, *principal_axes(rows, len(genes)), "id")).withColumnRenamed("vec", "v")
    near = cut(nearest(v, v.withColumnRenamed("id", "qid"), k - 1, skip_self=True).select(F.col("qid").alias("u"), F.col("id").alias("v"), "d"))
    labels = cut(near_clusters(v, near))
    places = plane(labels, near, k)
    at = s.createDataFrame(list(enumerate(genes)), "i int, gene string")
    logs = rows.select("id", "cell", F.explode(F.arrays_zip("i", "v")).alias("e")).join(at, F.col("e.i") == at.i).groupBy("id", "cell")
    logs = logs.agg(F.sort_array(F.collect_list(F.struct("gene", F.log1p("e.v").alias("value")))).alias("lognorm"))  # a cell's genes
    return logs.join(labels, "id").join(places, "id").select("cell", "lognorm", "umap_1", "umap_2", F.col("label").alias("cluster"))


@q("agg_pseudobulk_spatial")
def pseudobulk_spatial(s, d):
    """Sums per gene over spatial leaves of about equal numbers of cells (quantile cuts of x, then of y)."""
    own = placed(s, d).where("vendor_id IS NOT NULL").groupBy(F.col("vendor_id").alias("cell")).agg(F.min("dataset").alias("dataset"), F.min("x").alias("x"), F.min("y").alias("y"))
    own = cut(own)
    cuts = lambda df, c, keys: df.groupBy(*keys).agg(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias("cuts"))
    bin_of = lambda c: F.size(F.filter("cuts", lambda e: e < F.col(c)))
    bx = own.join(cuts(own, "x", ["dataset"]), "dataset").withColumn("ix", bin_of("x")).drop("cuts")
    by = bx.join(cuts(bx, "y", ["dataset", "ix"]), ["dataset", "ix"]).withColumn("iy", bin_of("y"))
    return counts(s, d).join(by.select("cell", "dataset", (F.col("ix") * 4 + F.col("iy")).alias("leaf")), "cell").groupBy("dataset", "leaf", "gene").agg(F.sum("n").alias("n"))


q("fn_string", f"SELECT DISTINCT marker_id, lower(trim(regexp_replace(label, '{SPACE_SQL}', ' ', 'g'))) || ', ' || coalesce(source, '') AS label, contains(label, 'cells') AS plural, replace(gene, '-', '_') AS gene FROM marker_annotations WHERE label IS NOT NULL AND trim(regexp_replace(label, '{SPACE_SQL}', ' ', 'g')) <> ''")(
    lambda s, d: table(s, d, "marker_annotations").withColumn("l", F.trim(F.regexp_replace("label", r"[\s\u00a0\u3000]+", " "))).where("label IS NOT NULL AND l <> ''")
    .select("marker_id", F.concat(F.lower("l"), F.lit(", "), F.coalesce("source", F.lit(""))).alias("label"), F.contains("label", F.lit("cells")).alias("plural"), F.replace("gene", F.lit("-"), F.lit("_")).alias("gene")).distinct()
)
_ITEMS = "coalesce(cell_type_level_2, '-') || ''', ''' || coalesce(h5ad_name, '-') || ''', ''' || dataset"
q("fn_array", f"""WITH l AS (SELECT DISTINCT obs_id, '[''' || {_ITEMS} || ''']' AS lit, len(X_spatial) AS n FROM h5ads WHERE X_spatial IS NOT NULL AND dataset IS NOT NULL)
SELECT obs_id, n, unnest(string_split(replace(substr(lit, 2, length(lit) - 2), '''', ''), ', ')) AS item FROM l""")(
    lambda s, d: _literals(s, d)
)


def _literals(s, d):
    """List literals as typed into a table's cell, read as arrays and exploded."""
    word = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("-")), F.lit("'"))
    lit = F.concat(F.lit("["), F.concat_ws(", ", word(F.col("cell_type_level_2")), word(F.col("h5ad_name")), word(F.col("dataset"))), F.lit("]"))
    rows = table(s, d, "h5ads").where("X_spatial IS NOT NULL AND dataset IS NOT NULL").select("obs_id", lit.alias("lit"), F.size("X_spatial").cast("bigint").alias("n")).distinct()
    return rows.select("obs_id", "n", F.explode(tab.literal_list(F.col("lit"))).alias("item"))


@q("src_glob", "SELECT dataset, count(*) AS n FROM labeled_transcripts GROUP BY dataset")
def first_of_glob(s, d):
    """The first of the paths that a pattern names, in the order of their names."""
    return s.read.parquet(store.first_match(s, f"{d}/labeled_*.parquet")).groupBy("dataset").agg(F.count("*").alias("n"))


q("fn_math", f"WITH {CELLS} SELECT id, round(log10(n_counts), 6) AS lg, round(ln(1 + n_counts), 6) AS l1, round(sqrt(n_counts), 6) AS root, round(power(10, -prob), 6) AS p, ceil(x) AS up, floor(y) AS down FROM cells WHERE n_counts > 0 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(prob)")(
    lambda s, d: cells(s, d).where("n_counts > 0 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(prob)").select("id", R(F.log10("n_counts")).alias("lg"), R(F.log1p("n_counts")).alias("l1"), R(F.sqrt("n_counts")).alias("root"), R(F.pow(F.lit(10.0), -F.col("prob"))).alias("p"), F.ceil("x").cast("double").alias("up"), F.floor("y").cast("double").alias("down"))
)
