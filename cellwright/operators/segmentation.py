"""Agreement of two cell assignments of the same molecules: ``a`` predicted, ``b`` target, ``pos`` a 0/1 property.

Rows with a null side count for the other side's totals only. The best partner of an ``a`` is the ``b`` that it shares
most molecules with; ties go to the smaller id. All metrics derive from one pre-aggregation per side, so the molecules are
shuffled once per side whatever number of metrics is asked for; skewed cells are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIVE = 0.33


def mask_low_score(tx: DataFrame, cell: str, score: str, least: float = 0.5) -> DataFrame:
    """Cell ids of rows with a score below ``least`` become null; a null score keeps its id."""
    return tx.withColumn(cell, F.when(F.col(score) < least, None).otherwise(F.col(cell)))


def side(tx: DataFrame, cell: str) -> DataFrame:
    """(cell, n, positive): molecules and share of positive ones; null cells left out."""
    return tx.where(F.col(cell).isNotNull()).groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("n"), F.avg(F.col("pos").cast("double")).alias("positive"))


def best_partner(tx: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, n): the partner that shares most molecules."""
    pairs = tx.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def agreement(tx: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(cell, jaccard, purity, recall): null where the sides are too small (10, 10 and 10, 10 and, for recall, 5 of b)."""
    na, nb = side(tx, a), side(tx, b).select(F.col("cell").alias("b"), F.col("n").alias("nb"))
    both = best_partner(tx, a, b).join(na.where(F.col("positive") > POSITIVE).select(F.col("cell").alias("a"), F.col("n").alias("na")), "a").join(nb, "b")
    n = F.col("n").cast("double")
    return both.select(
        F.col("a").alias("cell"),
        F.when((F.col("na") >= 10) & (F.col("nb") >= 10), n / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"),
        F.when(F.col("na") >= 10, n / F.col("na")).alias("purity"),
        F.when(F.col("nb") >= 5, n / F.col("nb")).alias("recall"),
    )


def contamination(tx: DataFrame, a: str = "a", least: int = 5) -> DataFrame:
    return side(tx, a).where((F.col("positive") > POSITIVE) & (F.col("n") > least)).select("cell", F.col("positive").alias("value"))


def num_transcripts(tx: DataFrame, a: str = "a") -> DataFrame:
    return side(tx, a).where(F.col("positive") > POSITIVE).select("cell", F.col("n").alias("value"))


def overlap(tx: DataFrame, a: str = "a", b: str = "b", score: str | None = None, share: float = 0.25, least: int = 5) -> DataFrame:
    """(cell b, value): how many ``a`` give more than ``share`` of their molecules to it.

    Without ``score`` shared molecules are positive ones and totals are all; with it both are the rows that have a score.
    """
    both, every = (tx.where(F.col(score).isNotNull()),) * 2 if score else (tx.where(F.col("pos") == 1), tx)
    total = every.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("a")).agg(F.count("*").alias("na"))
    pairs = both.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    hit = (F.col("n") / F.col("na") > share) & (F.col("na") > least)
    return pairs.join(total, "a").groupBy(F.col("b").alias("cell")).agg(F.sum(hit.cast("long")).alias("value"))


def all_metrics(tx: DataFrame, methods: dict[str, str | None], target: str) -> DataFrame:
    """(metric, segmentation, cell, value) of every method against ``target``; methods name their score column or None.

    The target itself reports its sizes, and one row of 0 without a cell for each measure of agreement.
    """
    fixed = [(m, target, None, 0.0) for m in ("jaccard", "purity", "recall", "overlap", "contamination")]
    out = [tx.sparkSession.createDataFrame(fixed, "metric string, segmentation string, cell string, value double"), num_transcripts(tx, target).select(F.lit("num_transcripts").alias("metric"), F.lit(target).alias("segmentation"), "cell", F.col("value").cast("double"))]
    for method, score in methods.items():
        rows = mask_low_score(tx, method, score) if score else tx
        tables = {"contamination": contamination(rows, method), "num_transcripts": num_transcripts(rows, method), "overlap": overlap(rows, method, target, score)}
        agreed = agreement(rows, method, target)
        tables |= {m: agreed.where(F.col(m).isNotNull()).select("cell", F.col(m).alias("value")) for m in ("jaccard", "purity", "recall")}
        out += [t.select(F.lit(m).alias("metric"), F.lit(method).alias("segmentation"), "cell", F.col("value").cast("double")) for m, t in tables.items()]
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    return every
