"""Classifiers, projections and label transfer over the matrix, with Spark ML."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.components import components_to_keep, nearest, on_axes, principal_axes
from cellwright.operators.matrix import normalize_total
from cellwright.operators.tables import first_per
from cellwright.runtime import cut


def sample_per(df: DataFrame, key: str, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows per group, chosen by a hash of the id (deterministic, without replacement)."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def entries(m: DataFrame, genes: list[str], target: float | None = 1000.0, log: bool = True) -> DataFrame:
    """(cell, i, v): the normalised (and logged) values of a cell that aren't zero, and their places in ``genes``, rising."""
    at = m.sparkSession.createDataFrame(list(enumerate(genes)), "i int, gene string")
    values = normalize_total(m, target).withColumn("v", F.log1p("norm") if log else F.col("norm")).join(at, "gene", "left")
    held = values.groupBy("cell").agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v")))).alias("x"))  # at most one entry per gene
    return held.select("cell", F.col("x.i").alias("i"), F.col("x.v").alias("v"))


def features(m: DataFrame, genes: list[str], target: float | None = 1000.0, log: bool = True) -> DataFrame:
    """(cell, features): sparse vector of a cell over ``genes``, the panel's vocabulary, from its :func:`entries`."""
    n = len(genes)
    vector = F.udf(lambda i, v: SparseVector(n, i, v), VectorUDT())
    return entries(m, genes, target, log).select("cell", vector("i", "v").alias("features"))


def train_annotator(m: DataFrame, typed: DataFrame, genes: list[str], per_type: int = 5000) -> tuple[PipelineModel, list[str]]:
    """Logistic regression of the type on at most ``per_type`` cells of each; returns the model and its type names."""
    labels = sorted(r.type for r in typed.select("type").distinct().collect())  # types, not cells
    code = F.create_map(*(F.lit(x) for i, t in enumerate(labels) for x in (t, float(i))))
    rows = features(m.join(dealt := cut(sample_per(typed, "type", "cell", per_type)), "cell", "left_semi"), genes).join(dealt, "cell").withColumn("label", code[F.col("type")])
    return Pipeline(stages=[LogisticRegression(maxIter=30, regParam=0.01)]).fit(cut(rows.select("features", "label"))), labels


def annotate(model: PipelineModel, labels: list[str], m: DataFrame, genes: list[str]) -> DataFrame:
    """(cell, type, probability, entropy) predicted for every cell."""
    p = model.transform(features(m, genes)).select("cell", F.col("prediction").cast("int").alias("i"), vector_to_array("probability").alias("p"))
    names = F.array(*map(F.lit, labels))
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return p.select("cell", F.element_at(names, F.col("i") + 1).alias("type"), F.array_max("p").alias("probability"), entropy.alias("entropy"))


def fit_projection(rows: DataFrame, column: str, share: float | None = None):
    """(model, number of components) of vectors: all components are fitted, then chosen by :func:`components_to_keep`."""
    dim = len(rows.select(column).first()[0])
    model = PCA(k=dim, inputCol=column, outputCol="pc").fit(rows)
    return model, components_to_keep(np.array([float(x) for x in model.explainedVariance]), share)


def project(v: DataFrame, column: str = "v", share: float | None = None) -> tuple[DataFrame, int]:
    """(id, pcs): centred projection on the first components, and how many were kept."""
    rows = cut(v.select("id", F.col(column).cast("array<double>").alias("x"))).select("id", array_to_vector("x").alias("x"))
    model, k = fit_projection(rows, "x", share)
    pcs = model.transform(rows).select("id", F.slice(vector_to_array("pc"), 1, k).alias("pcs"))
    mean = F.broadcast(pcs.agg(F.array(*(F.avg(F.element_at("pcs", i + 1)) for i in range(k))).alias("mean")))
    return pcs.crossJoin(mean).select("id", F.zip_with("pcs", "mean", lambda a, b: a - b).alias("pcs")), k


def transfer_labels(ref: DataFrame, typed: DataFrame, query: DataFrame, genes: list[str], k: int = 30) -> DataFrame:
    """(cell, type, share): the most frequent type among the k nearest reference cells.

    Components are fitted on the reference, and both sides are projected on them; every query cell asks all reference cells.
    Ties go to the smaller name; a query cell without a typed reference cell among its neighbours gets no row.
    """
    known, asking = (cut(entries(m, genes, 1e4).withColumn("loc", F.monotonically_increasing_id())) for m in (ref, query))
    axes, mean = principal_axes(known, len(genes))
    on = lambda rows, name: cut(on_axes(rows, axes, mean, "loc")).select(F.col("loc").alias(name), F.col("vec").alias("v"))
    near = nearest(on(known, "id"), on(asking, "qid"), k)
    voters = known.join(typed, "cell").select(F.col("loc").alias("id"), "type")
    votes = near.join(asking.select(F.col("loc").alias("qid"), "cell"), "qid").join(voters, "id").groupBy("cell", "type").agg(F.count("*").alias("n"))
    votes = votes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cell")))
    return first_per(votes, ["cell"], F.desc("n"), "type").select("cell", "type", "share")
