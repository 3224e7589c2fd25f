"""Markers of cell types and how specific they are. Input: the long matrix and (cell, type)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.operators.matrix import gene_moments, one_row
from cellwright.runtime import cut


def type_gene(m: DataFrame, typed: DataFrame) -> DataFrame:
    """(type, gene, cells, expressing, total) for every type and every gene, also those that never meet.

    The grid of types and genes is a small table made of the two dimensions, not of cells.
    """
    mt = m.join(typed, "cell")
    sizes = mt.groupBy("type").agg(F.count_distinct("cell").alias("cells"))
    grid = sizes.crossJoin(mt.select("gene").distinct())
    hits = mt.groupBy("type", "gene").agg(F.count("*").alias("expressing"), F.sum("n").alias("total"))
    out = grid.join(hits, ["type", "gene"], "left")
    return out.select("type", "gene", "cells", F.coalesce("expressing", F.lit(0)).alias("expressing"), F.coalesce("total", F.lit(0)).alias("total"))


def find_markers(tg: DataFrame, high: float = 5, low: float = 10, percentage: float = 50) -> DataFrame:
    """(type, gene, kind): positive = mean in the top ``high`` percent and expressed by ``percentage`` of the cells; negative = mean in the lowest ``low`` percent."""
    mean = tg.withColumn("mean", F.col("total").cast("double") / F.col("cells"))
    edges = mean.groupBy("type").agg(F.percentile("mean", 1 - high / 100).alias("top"), F.percentile("mean", low / 100).alias("bottom"))
    both = mean.join(edges, "type")
    kinds = F.array_compact(F.array(
        F.when((F.col("mean") >= F.col("top")) & (F.col("expressing").cast("double") / F.col("cells") >= percentage / 100), "positive"),
        F.when(F.col("mean") <= F.col("bottom"), "negative"),
    ))
    return both.select("type", "gene", F.explode(kinds).alias("kind"))


def exclusive_genes(tg: DataFrame, markers: DataFrame, inside: float = 0.2, outside: float = 0.05) -> DataFrame:
    """(type, gene): positive markers expressed by more than ``inside`` of the type and less than ``outside`` of the rest."""
    whole = tg.groupBy("gene").agg(F.sum("cells").alias("all_cells"), F.sum("expressing").alias("all_expressing"))
    t = tg.join(markers.where("kind = 'positive'").select("type", "gene"), ["type", "gene"], "left_semi").join(whole, "gene")
    rest = F.try_divide((F.col("all_expressing") - F.col("expressing")).cast("double"), F.col("all_cells") - F.col("cells"))
    return t.where((F.col("expressing").cast("double") / F.col("cells") > inside) & (rest < outside)).select("type", "gene")


def exclusive_pairs(genes: DataFrame) -> DataFrame:
    """(g1, g2): genes exclusive to two different types; a gene exclusive to both pairs with itself."""
    a, b = genes.select(F.col("type").alias("t1"), F.col("gene").alias("g1")), genes.select(F.col("type").alias("t2"), F.col("gene").alias("g2"))
    return a.join(b, F.col("t1") < F.col("t2")).select("g1", "g2").distinct()


def mecr(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g1, g2, rate): cells with both genes over cells with either; 0 where neither occurs.

    Genes of the asked pairs become bitmaps of cell numbers, in 64-bit words; a pair's common cells are the set bits of
    the words' conjunction, so a pair costs at most a 64th of the number of cells.
    """
    n = m.groupBy("gene").agg(F.count("*").alias("n"))
    pairs = cut(pairs)
    wanted = m.join(pairs.select(F.explode(F.array("g1", "g2")).alias("gene")).distinct(), "gene", "left_semi").select("cell", "gene")
    number = cut(wanted.select("cell").distinct().select("cell", F.monotonically_increasing_id().alias("i")))
    bit = F.expr("shiftleft(1L, cast(i & 63 AS int))")
    words = cut(wanted.join(number, "cell").groupBy("gene", F.shiftright("i", 6).alias("word")).agg(F.bit_or(bit).alias("bits")))
    side = lambda k: words.select(F.col("gene").alias(f"g{k}"), "word", F.col("bits").alias(f"b{k}"))
    both = pairs.join(side(1), "g1").join(side(2), ["g2", "word"]).groupBy("g1", "g2").agg(F.sum(F.bit_count(F.col("b1").bitwiseAND(F.col("b2")))).alias("both"))
    of = lambda k: n.select(F.col("gene").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
    out = pairs.join(of(1), "g1", "left").join(of(2), "g2", "left").join(both, ["g1", "g2"], "left").fillna(0, ["n1", "n2", "both"])
    return out.select("g1", "g2", F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("n1") + F.col("n2") - F.col("both")), F.lit(0.0)).alias("rate"))


def sensitivity(m: DataFrame, typed: DataFrame, markers: DataFrame) -> DataFrame:
    """(cell, type, value): share of a cell's counts that are positive markers of its type."""
    pos = markers.where("kind = 'positive'").select("type", "gene", F.lit(1).alias("hit"))
    s = m.join(typed, "cell").join(pos, ["type", "gene"], "left").groupBy("cell", "type").agg(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("t"))
    return s.select("cell", "type", F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("t")), F.lit(0.0)).alias("value"))


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def _beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, mirrored where that converges faster."""
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    return np.where(turn, 1 - front * out, front * out)


@F.pandas_udf(T.DoubleType())
def two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t with ``df`` degrees of freedom; null where either is."""
    ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
    v, tt = df.to_numpy(float)[ok], t.to_numpy(float)[ok] ** 2
    p = np.full(len(t), np.nan)
    p[ok] = np.clip(_beta(v / 2, np.full(len(v), 0.5), v / (v + tt)), 0, 1) if len(v) else []
    return pd.Series(p).astype(object).where(ok, None)


def cluster_scores(values: DataFrame, value: str, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, name, score): mean over a cluster's cells of the gene-set score - the mean standardised value of the set's genes less that of all others.

    ``values`` (cell, gene, value), ``sets`` (gene, name), ``clusters`` (cell, cluster). Means are linear, so cells are summed per
    cluster and gene first; absent entries count as zeros. Genes that never vary are left out.
    """
    mom = cut(gene_moments(values, value).where("sd > 0").select("gene", "mean", "sd"))
    named = cut(sets.distinct().join(mom, "gene"))
    size = named.groupBy("name").agg(F.count("*").alias("k"), F.sum(F.col("mean") / F.col("sd")).alias("base"))
    whole = one_row(mom, F.count("*").alias("k_all"), F.sum(F.col("mean") / F.col("sd")).alias("base_all"))
    cells = values.select("cell").distinct().join(clusters, "cell").groupBy("cluster").agg(F.count("*").alias("cells"))
    sums = cut(values.join(clusters, "cell").groupBy("cluster", "gene").agg(F.sum(value).alias("s")).join(mom, "gene").select("cluster", "gene", (F.col("s") / F.col("sd")).alias("u")))
    grid = cells.join(sums.groupBy("cluster").agg(F.sum("u").alias("u_all")), "cluster").crossJoin(size).crossJoin(whole)  # clusters by sets
    mine = sums.join(named.select("gene", "name"), "gene").groupBy("cluster", "name").agg(F.sum("u").alias("u"))
    out = grid.join(mine, ["cluster", "name"], "left").fillna(0.0, ["u"])
    inside = (F.col("u") / F.col("cells") - F.col("base")) / F.col("k")
    outside = F.try_divide((F.col("u_all") - F.col("u")) / F.col("cells") - (F.col("base_all") - F.col("base")), F.col("k_all") - F.col("k"))
    return out.select("cluster", "name", (inside - F.coalesce(outside, F.lit(0.0))).alias("score"))


def benjamini_hochberg(df: DataFrame, group: list[str], p: str, out: str) -> DataFrame:
    """Adjusted p per group of tests (one row per gene)."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.rank().over(w.orderBy(p)) + F.count("*").over(w.orderBy(p).rangeBetween(0, 0)) - 1).withColumn("__m", F.count(p).over(w))
    raw = ranked.withColumn("__q", F.col(p) * F.col("__m") / F.col("__r"))
    return raw.withColumn(out, F.least(F.lit(1.0), F.min("__q").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)))).drop("__r", "__m", "__q")


def one_vs_rest_t(tg_moments: DataFrame) -> DataFrame:
    """(type, gene, t, df) of Welch's test from (type, gene, cells, s, ss): sums and sums of squares over the type's cells."""
    all_ = tg_moments.groupBy("gene").agg(*(F.sum(c).alias(f"all_{c}") for c in ("cells", "s", "ss")))
    t = tg_moments.join(all_, "gene").where("cells > 1 AND all_cells - cells > 1")
    n1, n2 = F.col("cells").cast("double"), (F.col("all_cells") - F.col("cells")).cast("double")
    m1, m2 = F.col("s") / n1, (F.col("all_s") - F.col("s")) / n2
    v1 = (F.col("ss") - n1 * m1 * m1) / (n1 - 1) / n1
    v2 = (F.col("all_ss") - F.col("ss") - n2 * m2 * m2) / (n2 - 1) / n2
    return t.select("type", "gene", m1.alias("mean_in"), m2.alias("mean_out"), F.try_divide(m1 - m2, F.sqrt(v1 + v2)).alias("t"), F.try_divide((v1 + v2) ** 2, v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)).alias("df"))


def rank_sum(m: DataFrame, typed: DataFrame) -> DataFrame:
    """(type, gene, u, z): Wilcoxon rank sum of a type against the rest, tie-corrected, absent entries as tied zeros.

    Works on counts per (gene, value, type), whose number depends on distinct counts, not on cells.
    """
    mt = m.join(typed, "cell")
    sizes = cut(mt.groupBy("type").agg(F.count_distinct("cell").alias("cells")))
    n = one_row(sizes, F.sum("cells").alias("all_cells"))
    by = cut(mt.groupBy("gene", "type", "n").agg(F.count("*").alias("k")))
    level = by.groupBy("gene", "n").agg(F.sum("k").alias("k_all"))
    seen = level.groupBy("gene").agg(F.sum("k_all").alias("nonzero"))
    zeros = seen.crossJoin(n).select("gene", (F.col("all_cells") - F.col("nonzero")).alias("zero"), "all_cells")
    w = Window.partitionBy("gene").orderBy("n")
    ranks = level.join(zeros, "gene").withColumn("rank", F.col("zero") + F.sum("k_all").over(w) - (F.col("k_all") - 1) / 2)
    cube = lambda c: c.cast("double") ** 3 - c
    ties = ranks.groupBy("gene", "zero", "all_cells").agg((F.sum(cube(F.col("k_all"))) + cube(F.col("zero"))).alias("ties"))
    sums = by.join(ranks.select("gene", "n", "rank"), ["gene", "n"]).groupBy("gene", "type").agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("have"))
    out = sums.join(sizes, "type").join(ties, "gene")
    n1, n2, big = F.col("cells").cast("double"), (F.col("all_cells") - F.col("cells")).cast("double"), F.col("all_cells").cast("double")
    r = F.col("r") + (F.col("cells") - F.col("have")) * (F.col("zero") + 1) / 2
    u = r - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (big + 1 - F.col("ties") / (big * (big - 1))))
    return out.select("type", "gene", u.alias("u"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"))


def group_markers(tg: DataFrame, max_residual: float = 0.5, n_pts: int = 20, min_difference: float = 1.0, trials: int = 200, seed: int = 0) -> DataFrame:
    """(type, gene, residual, difference, marker): genes on or above a robust line through the most different ones.

    Per type the log10 means in and outside are compared; the ``n_pts`` largest differences carry a line fitted by seeded
    RANSAC (threshold: median absolute deviation). A gene absent on either side is not eligible.
    """
    whole = tg.groupBy("gene").agg(F.sum("cells").alias("c"), F.sum("total").alias("t"))
    u = tg.join(whole, "gene").where("total > 0 AND t > total")
    l1, l2 = F.log10(F.col("total") / F.col("cells")), F.log10((F.col("t") - F.col("total")) / (F.col("c") - F.col("cells")))
    rows = u.select("type", "gene", l1.alias("l1"), l2.alias("l2"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per gene
        pdf = pdf.sort_values("gene")
        top = pdf.assign(y=pdf.l1 - pdf.l2).nlargest(n_pts, "y")
        x, y = top.l2.to_numpy(), top.l1.to_numpy()
        slope, icept = (1.0, float(np.median(y - x))) if len(x) else (1.0, 0.0)
        if len(x) > 2 and np.ptp(x) > 0:
            limit, rng, best = np.median(np.abs(y - np.median(y))), np.random.default_rng(seed), -1
            for _ in range(trials):
                i, j = rng.choice(len(x), 2, replace=False)
                if x[i] == x[j]:
                    continue
                a = (y[j] - y[i]) / (x[j] - x[i])
                ok = np.abs(y - (y[i] + a * (x - x[i]))) <= limit
                if ok.sum() > best and np.ptp(x[ok]) > 0:
                    best = ok.sum()
                    slope, icept = np.polyfit(x[ok], y[ok], 1)
        residual = pdf.l1 - (slope * pdf.l2 + icept)
        diff = pdf.l1 - pdf.l2
        return pd.DataFrame({"type": pdf.type, "gene": pdf.gene, "residual": residual, "difference": diff, "marker": (residual >= -max_residual) & (diff >= min_difference)})

    return rows.groupBy("type").applyInPandas(fit, "type string, gene string, residual double, difference double, marker boolean")
