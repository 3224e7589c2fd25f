"""The layout of a neighbour graph in the plane, the graph of mutual neighbours, and the pipeline that uses both."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import DATA

from cellwright.operators import graph, layout
from cellwright.operators.components import leading_axes
from cellwright.plans import registry


def _near(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(len(x), np.inf))
    return [(i, int(j), float(d[i, j])) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[: min(k, len(x)) - 1]]


def test_curve_and_memberships():
    assert layout.falling_curve(0.1) == pytest.approx((1.57694, 0.895061), abs=1e-4)
    d = np.sort(np.random.default_rng(1).uniform(1, 3, size=(50, 14)), 1)
    for local in (0, 1):
        rho, sigma = layout.widths(d, 15, local, d.mean())
        assert (rho == (d[:, 0] if local else 0)).all()
        assert np.exp(-(d - rho[:, None]) / sigma[:, None]).sum(1) == pytest.approx(np.full(50, np.log2(15)), abs=1e-6)


def test_edges_of_mutual_neighbours(spark):
    near = _near(np.random.default_rng(2).normal(size=(80, 40)) * np.random.default_rng(3).uniform(size=(80, 1)), 6)  # some are near to many
    got = {(r.u, r.v): r.w for r in graph.mutual_jaccard(spark.createDataFrame(near, "u long, v long, d double")).collect()}
    of = {i: {i} for i in range(80)}
    for u, v, _ in near:
        of[u].add(v)
        of[v].add(u)
    want = {(u, v): len(of[u] & of[v]) / len(of[u] | of[v]) for u in of for v in of[u] if u <= v}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)


def test_layout_keeps_groups_apart(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 40)) + 4 * np.eye(3, 40)[np.arange(600) % 3]
    near = spark.createDataFrame(_near(x, 15), "u long, v long, d double")
    at = layout.plane_layout(near, 600, 15, epochs=200)
    assert at.shape == (600, 2) and np.isfinite(at).all() and (at == layout.plane_layout(near, 600, 15, epochs=200)).all()
    d = ((at[:, None] - at[None]) ** 2).sum(2) + np.diag(np.full(600, np.inf))
    same = np.argsort(d, 1)[:, :10] % 3 == (np.arange(600) % 3)[:, None]
    assert same.mean() > 0.95
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for whole in (graph.WHOLE, 1000):  # every node through the whole graph, or inside blocks first
        label = graph.near_clusters(v, near, whole=whole).toPandas().set_index("id").label.sort_index().to_numpy()
        assert len(label) == 600 and sum(np.bincount(np.arange(600)[label == c] % 3).max() for c in set(label)) > 570


def test_layout_holds_points_that_are_near_to_many(spark):
    x = np.random.default_rng(6).normal(size=(800, 30))
    x[0] = 0
    near = [e for e in _near(x, 15) if e[0]] + [(0, i, 4.0) for i in range(1, 15)]
    at = layout.plane_layout(spark.createDataFrame(near, "u long, v long, d double"), 800, 15, epochs=200)
    assert sum(v == 0 for _, v, _ in near) > 700 and np.abs(at - np.median(at, 0)).max() < 30


def test_layout_of_few_points(spark):
    for n in (0, 1, 2, 5):
        near = spark.createDataFrame(_near(np.arange(2.0 * n).reshape(n, 2) ** 2, 15), "u long, v long, d double")
        at = layout.plane_layout(near, n, 15, epochs=30)
        assert at.shape == (n, 2) and np.isfinite(at).all()


def test_no_more_components_than_rows():
    x = np.random.default_rng(5).normal(size=(6, 40))
    a, b = np.triu_indices(40)
    axes = leading_axes(a, b, (x.T @ x / 6)[a, b], x.mean(0), most=6)
    share = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    c = np.cumsum(share / share.sum())
    assert axes.shape[1] == max(1, int(np.abs(5 * (c - c[0]) - (c[-1] - c[0]) * np.arange(6)).round(9).argmax()))


def test_pipeline_takes_all_steps(spark):
    out = registry.QUERIES["preprocess_pipeline"](spark, DATA).toPandas()
    assert sorted(out.columns) == ["cell", "cluster", "lognorm", "umap_1", "umap_2"] and len(out) and out.cell.is_unique
    assert np.isfinite(out[["umap_1", "umap_2"]].to_numpy()).all() and out.cluster.notna().all()
    total = {sum(np.expm1(e.value) for e in cell) for cell in out.lognorm}  # every cell has the median total
    assert max(total) - min(total) < 1e-6 * max(total)
