"""The cell by gene matrix in long form (cell, gene, n), and what is derived from it.

Absent rows are zeros: means, deviations and correlations use the number of cells as denominator and never densify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.runtime import cut


def totals(m: DataFrame) -> DataFrame:
    return m.groupBy("cell").agg(F.sum("n").alias("total"))


def one_row(df: DataFrame, *aggs: Column) -> DataFrame:
    return F.broadcast(df.agg(*aggs))


def normalize_total(m: DataFrame, target: float | None = None) -> DataFrame:
    """Adds ``norm``: counts scaled so that each cell sums to ``target``, by default the median total."""
    t = totals(m)
    goal = one_row(t, F.percentile("total", 0.5).alias("target")) if target is None else None
    scaled = m.join(t, "cell")
    scaled = scaled.crossJoin(goal) if goal is not None else scaled.withColumn("target", F.lit(float(target)))
    return scaled.select("cell", "gene", "n", (F.col("n") * F.col("target") / F.col("total")).alias("norm"))


def log1p(m: DataFrame, value: str = "norm") -> DataFrame:
    return m.withColumn(f"log_{value}", F.log1p(value))


def gene_moments(m: DataFrame, value: str) -> DataFrame:
    """(gene, mean, sd) over all cells of the matrix, zeros included (population deviation)."""
    cells = one_row(m, F.count_distinct("cell").alias("cells"))
    s = m.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("ss")).crossJoin(cells)
    mean = F.col("s") / F.col("cells")
    return s.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("cells") - mean * mean)).alias("sd"), "cells")


def zscore(m: DataFrame, value: str) -> DataFrame:
    """Adds ``z`` on the stored entries; an absent entry's z is ``-mean / sd`` of its gene. Null where a gene never varies."""
    return m.join(gene_moments(m, value), "gene").withColumn("z", F.try_divide(F.col(value) - F.col("mean"), F.col("sd")))


def kneepoint(df: DataFrame, order: str, value: str) -> DataFrame:
    """(idx, value): the place in the order farthest from the line between the first and the last value.

    A falling curve is mirrored. One partition, so for short curves (one row per component, bin or distinct value).
    """
    w = Window.orderBy(order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = df.select(F.col(value).cast("double").alias("value"), (F.row_number().over(w) - 1).alias("idx"), F.first(F.col(value).cast("double")).over(full).alias("a"), F.last(F.col(value).cast("double")).over(full).alias("b"), (F.count("*").over(full) - 1).alias("n"))
    sign = F.when(F.col("a") > F.col("b"), -1.0).otherwise(1.0)
    rise = (F.col("b") - F.col("a")) * sign
    run = F.col("n").cast("double")
    off = F.abs(run * (F.col("value") - F.col("a")) * sign - rise * F.col("idx")) / F.sqrt(run * run + rise * rise)
    return c.select("idx", "value", F.round(off, 9).alias("off")).orderBy(F.desc("off"), "idx").limit(1).select("idx", "value")


def knee_of_totals(totals: DataFrame, total: str) -> DataFrame:
    """(value): the total at the knee of the sorted log10 totals, found from counts per distinct total.

    A run of equal totals is farthest from the line between first and last total at one of its ends, so two places per
    distinct total are looked at; ties go to the first place.
    """
    h = totals.where(F.col(total) > 0).groupBy(F.col(total).alias("value")).agg(F.count("*").alias("k"))
    w = Window.orderBy("value")  # one row per distinct total
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    log = F.log10("value")
    c = h.select("value", log.alias("v"), F.sum("k").over(w).alias("upto"), "k", F.min(log).over(full).alias("a"), F.max(log).over(full).alias("b"), (F.sum("k").over(full) - 1).alias("run"))
    c = c.select("value", "v", "a", "b", "run", F.explode(F.array(F.col("upto") - F.col("k"), F.col("upto") - 1)).alias("idx"))
    off = F.abs(F.col("run") * (F.col("v") - F.col("a")) - (F.col("b") - F.col("a")) * F.col("idx")) / F.sqrt(F.col("run") ** 2 + (F.col("b") - F.col("a")) ** 2)
    return c.select("value", "idx", F.round(off, 9).alias("off")).orderBy(F.desc("off"), "idx").limit(1).select("value")


def cross_products(m: DataFrame, value: str) -> DataFrame:
    """(g1, g2, both, xy), g1 < g2: cells that have both genes, and the sum of products of their values; pairs that never meet are absent."""
    side = lambda k: m.select("cell", F.col("gene").alias(f"g{k}"), F.col(value).alias(f"v{k}"))
    return side(1).join(side(2), "cell").where("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("both"), F.sum(F.col("v1") * F.col("v2")).alias("xy"))  # a cell has at most the panel's genes


def correlations(m: DataFrame, value: str) -> DataFrame:
    """(g1, g2, r), g1 < g2: Pearson correlation over all cells of every two genes, zeros included; null if either never varies."""
    mom = cut(gene_moments(m, value))
    of = lambda k: mom.select(F.col("gene").alias(f"g{k}"), F.col("mean").alias(f"m{k}"), F.col("sd").alias(f"s{k}"), F.col("cells").alias(f"c{k}"))
    out = of(1).join(of(2), F.col("g1") < F.col("g2")).join(cross_products(m, value), ["g1", "g2"], "left")  # genes by genes: the result
    cov = F.coalesce("xy", F.lit(0.0)) / F.col("c1") - F.col("m1") * F.col("m2")
    return out.select("g1", "g2", F.try_divide(cov, F.col("s1") * F.col("s2")).alias("r"))


def correlation_blocks(m: DataFrame, value: str, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Correlations inside and between groups (gene, label) without the table of all pairs: genes (gene, label, mean, sd); pairs
    (label, g1, g2, r) of the same label that share a cell; blocks (l1, l2, r), l1 <= l2, with the mean over all pairs of the two.

    Sums per cell and label give the means. A pair with a gene that never varies counts as -1.
    """
    mom = gene_moments(m, value).join(groups.where("label IS NOT NULL"), "gene")
    genes = cut(mom.select("gene", "label", "mean", "sd", "cells"))
    own = cut(m.select("cell", "gene", value).join(genes, "gene").select("cell", "gene", "label", value, "sd"))
    side = lambda k: own.select("cell", "label", F.col("gene").alias(f"g{k}"), F.col(value).alias(f"v{k}"))
    met = side(1).join(side(2), ["cell", "label"]).where("g1 < g2").groupBy("label", "g1", "g2").agg(F.sum(F.col("v1") * F.col("v2")).alias("xy"))
    of = lambda k: genes.select(F.col("gene").alias(f"g{k}"), F.col("mean").alias(f"m{k}"), F.col("sd").alias(f"s{k}"), "cells")
    cov = F.col("xy") / F.col("cells") - F.col("m1") * F.col("m2")
    pairs = met.join(of(1), "g1").join(of(2).drop("cells"), "g2").select("label", "g1", "g2", F.try_divide(cov, F.col("s1") * F.col("s2")).alias("r"))
    vary = F.col("sd") > 0
    size = cut(genes.groupBy("label").agg(F.count("*").alias("n"), F.count_if(vary).alias("k"), F.coalesce(F.sum(F.when(vary, F.col("mean") / F.col("sd"))), F.lit(0.0)).alias("t"), F.max("cells").alias("cells")))
    held = own.where(vary).groupBy("cell", "label").agg(F.sum(F.col(value) / F.col("sd")).alias("a"))
    at = lambda k: held.select("cell", F.col("label").alias(f"l{k}"), F.col("a").alias(f"a{k}"))
    both = at(1).join(at(2), "cell").where("l1 <= l2").groupBy("l1", "l2").agg(F.sum(F.col("a1") * F.col("a2")).alias("aa"))
    lab = lambda k: size.select(*(F.col(c).alias(f"{c[0]}{k}") for c in ("label", "n", "k", "t")), F.col("cells").alias(f"cells{k}"))
    blocks = lab(1).join(lab(2), F.col("l1") <= F.col("l2")).join(both, ["l1", "l2"], "left")  # labels by labels
    every = F.coalesce("aa", F.lit(0.0)) / F.col("cells1") - F.col("t1") * F.col("t2") - (F.col("n1") * F.col("n2") - F.col("k1") * F.col("k2"))
    return genes, pairs, blocks.select("l1", "l2", (every / (F.col("n1") * F.col("n2"))).alias("r"))


def downsample(m: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Cells of more than ``most`` counts thinned to exactly ``most``, without replacement, in a hash order of the single counts."""
    one = m.select("cell", "gene", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    w = Window.partitionBy("cell").orderBy(F.xxhash64("cell", "gene", "i", F.lit(seed)), "gene", "i")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("cell", "gene").agg(F.count("*").alias("n"))


def pseudobulk(m: DataFrame, groups: int, seed: int = 0) -> DataFrame:
    """Cells dealt to ``groups`` pseudosamples by a hash, then summed."""
    return m.groupBy(F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(groups)).alias("sample"), "gene").agg(F.sum("n").alias("n"))


def size_factors(m: DataFrame) -> DataFrame:
    """(sample, factor): median of ratios to the geometric mean, over genes present in every sample."""
    samples = one_row(m, F.count_distinct("sample").alias("samples"))
    common = m.where("n > 0").groupBy("gene").agg(F.count_distinct("sample").alias("k"), F.avg(F.ln("n")).alias("geo")).crossJoin(samples).where("k = samples")
    return m.join(common, "gene").groupBy("sample").agg(F.exp(F.percentile(F.ln("n") - F.col("geo"), 0.5)).alias("factor"))
