"""Differential expression between two conditions of pseudobulk samples: negative binomial regression with a Wald test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators.markers import benjamini_hochberg, two_sided
from cellwright.operators.matrix import size_factors
from cellwright.runtime import cut, parts


def _fit(y: np.ndarray, factor: np.ndarray, case: np.ndarray, rounds: int) -> pd.DataFrame:
    """All genes of a batch at once: counts ``y`` (genes x samples); reweighted least squares for log mean = log factor + a + b case."""
    norm = y / factor
    groups = [norm[:, case == k] for k in (0, 1)]
    mean, within = norm.mean(1), sum(((g - g.mean(1, keepdims=True)) ** 2).sum(1) for g in groups) / max(1, y.shape[1] - 2)
    alpha = np.clip((within - mean * (1 / factor).mean()) / np.maximum(mean, 1e-9) ** 2, 1e-8, 10.0)[:, None]
    start = [np.log(np.maximum(g.mean(1), 1e-3)) for g in groups]
    a, b = start[0], start[1] - start[0]
    for _ in range(rounds):
        eta = np.clip(a[:, None] + b[:, None] * case, -20, 25)
        mu = factor * np.exp(eta)
        w = mu / (1 + alpha * mu)
        z = eta + (y - mu) / mu
        s0, s1 = w.sum(1), (w * case).sum(1)
        t0, t1 = (w * z).sum(1), (w * z * case).sum(1)
        det = np.maximum(s0 * s1 - s1 * s1, 1e-12)  # case is 0 or 1, so its square is itself
        a, b = np.clip((s1 * t0 - s1 * t1) / det, -20, 25), np.clip((s0 * t1 - s1 * t0) / det, -25, 25)
    se = np.sqrt(s0 / det)
    return pd.DataFrame({"base_mean": mean, "log2_fold_change": b / np.log(2), "lfc_se": se / np.log(2), "stat": b / se, "dispersion": alpha[:, 0]})


def negative_binomial_test(m: DataFrame, samples: DataFrame, rounds: int = 25) -> DataFrame:
    """(gene, base_mean, log2_fold_change, lfc_se, stat, dispersion, pvalue, padj), condition 1 against condition 0.

    ``m`` (sample, gene, n) and ``samples`` (sample, condition 0 or 1): pseudobulks, so a gene has one count per sample and the
    list of samples is small; the genes are spread over the cluster. Size factors are medians of ratios. The dispersion is
    the gene's own moment estimate; no shrinkage over genes and no refit of outliers. Samples without a usable size
    factor, genes without counts and comparisons that lack a condition give no row; a missing count is 0.
    """
    known = samples.where("condition IN (0, 1)").dropDuplicates(["sample"])
    counts = cut(m.join(known.select("sample"), "sample", "left_semi").groupBy("sample", "gene").agg(F.sum("n").cast("double").alias("n")).where("n > 0"))
    design = known.join(size_factors(counts), "sample").where("factor > 0").select("sample", "condition", "factor").orderBy("sample").collect()  # one row per pseudobulk
    schema = "gene string, base_mean double, log2_fold_change double, lfc_se double, stat double, dispersion double"
    if {r.condition for r in design} != {0, 1}:
        return m.sparkSession.createDataFrame([], schema + ", pvalue double, padj double")
    at = {r.sample: i for i, r in enumerate(design)}
    factor, case = np.array([r.factor for r in design]), np.array([float(r.condition) for r in design])
    rows = counts.where(F.col("sample").isin(list(at))).groupBy("gene").agg(F.collect_list(F.struct("sample", "n")).alias("row"))

    def run(batches):
        for pdf in batches:
            y = np.zeros((len(pdf), len(at)))
            for i, row in enumerate(pdf["row"]):
                for e in row:
                    y[i, at[e["sample"]]] = e["n"]
            yield pd.concat([pdf[["gene"]].reset_index(drop=True), _fit(y, factor, case, rounds)], axis=1)

    fitted = cut(rows.repartition(parts(m.sparkSession, 1), "gene").mapInPandas(run, schema).withColumn("pvalue", two_sided("stat")))
    return benjamini_hochberg(fitted.withColumn("__all", F.lit(1)), ["__all"], "pvalue", "padj").drop("__all")
