"""What surrounds a cell: labels of its neighbours, distance to a type, autocorrelation of genes, scores of clusterings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators.knn import distance_rows, matrix, over_blocks
from cellwright.operators.matrix import gene_moments
from cellwright.operators.tables import average_rank
from cellwright.runtime import cut


def neighbour_labels(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, n): how many of a cell's neighbours carry each label; labels (id, label) without nulls."""
    return knn.join(labels.withColumnRenamed("id", "nb"), "nb").groupBy("id", "label").agg(F.count("*").alias("n"))


def spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """(group, rho, n): correlation of average ranks within groups, rows with a null left out."""
    ranked = average_rank(average_rank(cut(df.select(*group, a, b).dropna()), a, group, "ra"), b, group, "rb")
    return ranked.groupBy(*group).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def autocorrelation(m: DataFrame, knn: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, moran, z): Moran's I of each gene over the neighbour graph, zeros included, with its normal score.

    Only stored counts are joined; absent ones enter through the gene's mean: sum of (x-m)(y-m) over edges is
    sum xy - m (sum of x over outgoing + sum of y over incoming ends) + edges m^2.
    """
    edges = knn.where("id <> nb").select("id", "nb")
    mm = m.join(genes, "gene", "left_semi")
    mom = gene_moments(mm, "n")
    e = edges.agg(F.count("*").alias("edges"))
    x, y = mm.select(F.col("cell").alias("id"), "gene", F.col("n").alias("x")), mm.select(F.col("cell").alias("nb"), "gene", F.col("n").alias("y"))
    out = edges.groupBy("id").agg(F.count("*").alias("k")).join(x, "id").groupBy("gene").agg(F.sum(F.col("k") * F.col("x")).alias("sx"))
    inn = edges.groupBy("nb").agg(F.count("*").alias("k")).join(y, "nb").groupBy("gene").agg(F.sum(F.col("k") * F.col("y")).alias("sy"))
    xy = edges.join(x, "id").join(y, ["nb", "gene"]).groupBy("gene").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    s = mom.join(out, "gene", "left").join(inn, "gene", "left").join(xy, "gene", "left").fillna(0).crossJoin(F.broadcast(e))
    cov = F.col("xy") - F.col("mean") * (F.col("sx") + F.col("sy")) + F.col("edges") * F.col("mean") ** 2
    moran = F.try_divide(cov / F.col("edges"), F.col("sd") ** 2)
    return s.select("gene", moran.alias("moran"), ((moran + 1 / (F.col("cells") - 1)) * F.sqrt(F.col("edges"))).alias("z"))


def local_correlation(m: DataFrame, knn: DataFrame, genes: DataFrame) -> DataFrame:
    """(g1, g2, z), g1 < g2: how far one gene's counts go with the other's in the neighbours, zeros included, as a normal score.

    A cell first sums its neighbours' counts per gene; that row meets the cell's own counts, so the work grows with cells,
    not with edges times pairs. Both directions are averaged. ``genes`` is a short list; null for a gene that never varies.
    """
    edges = knn.where("id <> nb").select("id", "nb")
    mm = cut(m.join(genes, "gene", "left_semi").select("cell", "gene", "n"))
    mom = gene_moments(mm, "n")
    e = edges.agg(F.count("*").alias("edges"))
    around = edges.join(mm.select(F.col("cell").alias("nb"), F.col("gene").alias("h"), "n"), "nb").groupBy("id", "h").agg(F.sum("n").alias("y"))
    around = cut(around)
    own = mm.select(F.col("cell").alias("id"), "gene", "n")
    xy = own.join(around, "id").groupBy("gene", "h").agg(F.sum(F.col("n") * F.col("y")).alias("xy"))
    out = edges.groupBy("id").agg(F.count("*").alias("k")).join(own, "id").groupBy("gene").agg(F.sum(F.col("k") * F.col("n")).alias("sx"))
    inn = around.groupBy(F.col("h").alias("gene")).agg(F.sum("y").alias("sy"))
    one = cut(mom.join(out, "gene", "left").join(inn, "gene", "left").fillna(0).crossJoin(F.broadcast(e)))
    a, b = one.select(F.col("gene"), "mean", "sd", "sx", "edges"), one.select(F.col("gene").alias("h"), F.col("mean").alias("mean_h"), F.col("sd").alias("sd_h"), F.col("sy").alias("sy_h"))
    pairs = a.join(b, F.col("gene") != F.col("h")).join(xy, ["gene", "h"], "left").fillna(0, ["xy"])  # the short list with itself
    cov = F.col("xy") - F.col("mean_h") * F.col("sx") - F.col("mean") * F.col("sy_h") + F.col("edges") * F.col("mean") * F.col("mean_h")
    z = F.try_divide(cov, F.col("sd") * F.col("sd_h") * F.sqrt("edges"))
    return pairs.groupBy(F.least("gene", "h").alias("g1"), F.greatest("gene", "h").alias("g2")).agg(F.avg(z).alias("z"))


def module_scores(m: DataFrame, modules: DataFrame) -> DataFrame:
    """(cell, module, score): mean standardised count of the module's genes, for every cell of the matrix, zeros included."""
    mod = cut(modules.where("module >= 0"))
    mm = m.join(mod, "gene")
    mom = gene_moments(m, "n").join(mod, "gene").where("sd > 0")
    size = mom.groupBy("module").agg(F.count("*").alias("k"), F.sum(F.col("mean") / F.col("sd")).alias("base"))
    have = mm.join(mom.select("gene", "sd"), "gene").groupBy("cell", "module").agg(F.sum(F.col("n") / F.col("sd")).alias("s"))
    grid = m.select("cell").distinct().join(F.broadcast(size))  # modules are few: at most a third of the genes asked for
    out = grid.join(have, ["cell", "module"], "left")
    return out.select("cell", "module", ((F.coalesce("s", F.lit(0.0)) - F.col("base")) / F.col("k")).alias("score"))


def calinski_harabasz(v: DataFrame) -> DataFrame:
    """(score) of labelled vectors (label, v): between over within sums of squares, from sums per label and dimension."""
    e = v.select("label", F.posexplode("v").alias("i", "x"))
    by = e.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    all_ = by.groupBy("i").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    j = by.join(all_, "i")
    between = F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("all_s") / F.col("all_n")) ** 2)
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    out = j.agg(between.alias("b"), within.alias("w"), F.count_distinct("label").alias("k"), F.max("all_n").alias("n"))
    return out.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def silhouette(v: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, silhouette) of the stated queries (qid, label, q) against all vectors (id, label, v), Euclidean.

    Blocks of vectors meet blocks of queries; a block sends only its sum and number of distances per query and label.
    """
    g = F.lit(0).cast("long").alias("g")
    vectors = v.select(g, F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v")).dropna()
    asked = queries.select(g, F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).dropna()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, ids, y, qids = matrix(left["v"]), left["id"].to_numpy(), matrix(right["q"]), right["qid"].to_numpy()
            names, at = np.unique(left["label"].to_numpy(), return_inverse=True)
            one = np.eye(len(names))[at]
            for s, d2, _ in distance_rows(y, x):
                d2[qids[s, None] == ids[None]] = 0.0
                out.append((np.repeat(qids[s], len(names)), np.tile(names, len(d2)), (np.sqrt(d2) @ one).ravel(), np.tile(one.sum(0).astype(np.int64), len(d2))))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in (np.int64, np.int32, float, np.int64)]
        return pa.table(dict(zip(("qid", "other", "s", "k"), cols)))

    per = over_blocks(vectors, asked, run, "qid long, other int, s double, k long").groupBy("qid", "other").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    per = per.join(queries.select("qid", "label"), "qid")
    a = F.max(F.when(F.col("other") == F.col("label"), F.try_divide(F.col("s"), F.col("k") - 1)))
    b = F.min(F.when(F.col("other") != F.col("label"), F.col("s") / F.col("k")))
    return per.groupBy("qid").agg(a.alias("a"), b.alias("b")).select("qid", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))
