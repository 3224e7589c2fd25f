"""Modularity communities run until nothing more is gained, on fixtures where few rounds leave fragments."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from cellwright.operators import graph
from cellwright.operators.graph import SMALL, communities


def _nearest(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {tuple(sorted((i, int(j)))) for i in range(len(x)) for j in np.argsort(d[i])[:k]}


def _modularity(pairs, c):
    inside, degree = Counter(), Counter()
    for u, v in pairs:
        inside[c[u]] += c[u] == c[v]
        degree[c[u]] += 1
        degree[c[v]] += 1
    return sum(inside[k] / len(pairs) - (degree[k] / 2 / len(pairs)) ** 2 for k in degree)


@pytest.mark.parametrize("small", [2_000, SMALL])  # the large group in rounds over tables first, or all in single tasks
def test_communities_run_to_the_end(spark, small):
    rng = np.random.default_rng(4)
    groups = {7: (0, rng.uniform(size=(1500, 2))), 8: (10_000, rng.uniform(size=(60, 2)))}
    pairs = {g: {(a + at, b + at) for a, b in _nearest(x, 8)} for g, (at, x) in groups.items()}
    nodes = spark.createDataFrame([(at + i, g) for g, (at, x) in groups.items() for i in range(len(x))] + [(20_000, 9)], "loc long, g long")
    edges = spark.createDataFrame([(g, u, v, 1.0) for g, ps in pairs.items() for a, b in ps for u, v in ((a, b), (b, a))], "g long, u long, v long, w double")
    c = {r.loc: r.c for r in communities(nodes, edges, small=small).collect()}
    assert len(c) == 1561 and c[20_000] == 20_000
    for g, least in ((7, 0.86), (8, 0.55)):
        assert _modularity(pairs[g], c) > least
    sizes = Counter(v for k, v in c.items() if k < 10_000)
    assert len(sizes) < 45 and min(sizes.values()) > 10
    of = defaultdict(set)
    for k, v in c.items():
        of[v].add(k // 10_000)
    assert all(len(x) == 1 for x in of.values())  # no community crosses groups


def test_graph_of_many_dimensions_is_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 60))
    x[:200, :5] += 6
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g long, loc long, vec array<double>")
    box = spark.createDataFrame([(x.min(0).tolist(), x.max(0).tolist())], "low array<double>, high array<double>")
    got = graph._wide_graph(rows, box, 60, 15).toPandas()
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(600, np.inf))
    assert {(u, v) for u, v in zip(got.u, got.v)} == {(i, int(j)) for i in range(600) for j in np.argsort(d, 1)[i, :15]}
    assert len(got) == 9000 and got.groupby("u").block.nunique().eq(1).all()
    labels = graph.neighbour_clusters(rows.selectExpr("loc AS id", "vec AS v"), 15).toPandas().set_index("id").label
    assert set(labels[labels.index < 200]).isdisjoint(labels[labels.index >= 200]) and len(labels) == 600
