"""Local correlation, modules, leaf orders and the negative binomial test, against numpy on small fixtures."""

from __future__ import annotations


import numpy as np
import pytest

from cellwright.operators import components, models, ordering
from cellwright.operators.differential import negative_binomial_test
from cellwright.operators.matrix import correlation_blocks, correlations
from cellwright.operators.spatial import local_correlation, module_scores


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(0.8, (30, 4))
    x[0] = 1  # every cell row below has at least one count
    near = [(i, int(j)) for i in range(30) for j in rng.choice(30, 4, replace=False)]
    m = spark.createDataFrame([(i, f"g{k}", int(x[i, k])) for i in range(30) for k in range(4) if x[i, k]], "cell long, gene string, n long")
    knn = spark.createDataFrame(near, "id long, nb long")
    return x.astype(float), near, m, knn


def test_local_correlation_against_numpy(spark, small):
    x, near, m, knn = small
    cells = [i for i in range(30) if x[i].any()]
    mean, sd = x[cells].mean(0), x[cells].std(0)
    edges = [(i, j) for i, j in near if i != j]
    got = {(r.g1, r.g2): r.z for r in local_correlation(m, knn, m.select("gene").distinct()).collect()}
    for a in range(4):
        for b in range(a + 1, 4):
            one = lambda p, q: sum((x[i, p] - mean[p]) * (x[j, q] - mean[q]) for i, j in edges) / (sd[p] * sd[q] * len(edges) ** 0.5)
            assert got[f"g{a}", f"g{b}"] == pytest.approx((one(a, b) + one(b, a)) / 2)
    assert len(got) == 6


def test_module_scores_against_numpy(spark, small):
    x, _, m, _ = small
    cells = [i for i in range(30) if x[i].any()]
    z = (x - x[cells].mean(0)) / x[cells].std(0)
    mods = spark.createDataFrame([("g0", 0), ("g1", 0), ("g2", 0), ("g3", -1)], "gene string, module int")
    got = {r.cell: r.score for r in module_scores(m, mods).collect()}
    assert set(got) == set(cells) and all(got[i] == pytest.approx(z[i, :3].mean()) for i in cells)


def test_linkage():
    near = np.array([[1, 0.9, 0.1, 0.2], [0.9, 1, 0.3, 0.1], [0.1, 0.3, 1, 0.8], [0.2, 0.1, 0.8, 1]])
    assert ordering.linkage_groups(near, "average", 0.5) == [[0, 1], [2, 3]]
    assert ordering.linkage_groups(near, "single") == [[0, 1, 2, 3]]
    assert ordering.linkage_groups(near, "complete", 0.95) == [[0], [1], [2], [3]]
    assert ordering.linkage_groups(np.zeros((0, 0)), "single") == []


def test_orders_and_modules(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.8), ("a", "c", 0.1), ("b", "c", 0.3), ("a", "d", 0.2), ("b", "d", None)], "g1 string, g2 string, r double")
    line = [(r.thing, round(r.position, 6)) for r in ordering.leaf_positions(pairs).orderBy("place").collect()]
    assert [x for x, _ in line] == ["a", "b", "c", "d"] and line[0][1] == 0 and line[-1][1] == 1
    labels = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("d", None)], "gene string, label string")
    assert [r.gene for r in ordering.block_order(pairs, labels).orderBy("place").collect()] == ["a", "c", "b"]
    mods = {r.gene: r.module for r in ordering.modules(pairs, 0.5, 2, "r").collect()}
    assert mods == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert ordering.modules(pairs, 0.5, 3, "r").where("module >= 0").count() == 0
    empty = pairs.where("false")
    assert ordering.modules(empty, 0.5, 3, "r").count() == 0 and ordering.leaf_positions(empty).count() == 0


def test_leaves_without_a_matrix():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        m = rng.integers(0, rng.integers(2, 30), (n := int(rng.integers(1, 14)), n)).astype(float)  # many ties
        m = np.maximum(m, m.T)
        assert ordering.single_leaves(n, lambda i: m[i]) == [i for g in ordering.linkage_groups(m, "single") for i in g]


def test_more_genes_than_a_matrix_holds_are_ordered(spark, small):
    _, _, m, _ = small
    labels = spark.createDataFrame([(f"g{k}", "x" if k % 2 else "y") for k in range(4)], "gene string, label string")
    rows = lambda df: [(r.gene, r.label, r.place) for r in df.orderBy("place").collect()]
    both = ordering.place_blocks(*correlation_blocks(m, "n", labels)), ordering.block_order(correlations(m, "n"), labels)
    assert rows(both[0]) == rows(both[1]) and len(rows(both[0])) == 4
    n = ordering.MOST + 101
    wide = m.unionByName(spark.range(n).selectExpr("id % 30 AS cell", "'h' || id AS gene", "1L AS n"))
    labels = labels.union(spark.range(n).selectExpr("'h' || id", "if(id % 3 = 0, 'x', 'z')"))
    got = rows(ordering.place_blocks(*correlation_blocks(wide, "n", labels)))
    assert [p for *_, p in got] == list(range(n + 4)) and len({g for g, *_ in got}) == n + 4
    chain = spark.range(n).selectExpr("lpad(id, 5, '0') AS g1", "lpad(id + 1, 5, '0') AS g2", "0.5D AS r")
    assert [g for g, *_ in rows(ordering.block_order(chain, chain.selectExpr("g1 AS gene", "'a' AS label")))] == [f"{i:05d}" for i in range(n)]


def test_features_hold_only_what_a_cell_has(spark):
    m = spark.createDataFrame([(1, "b", 3), (1, "a", 1), (2, "stray", 5)], "cell long, gene string, n long")
    genes = ["a", *(f"a{i:05d}" for i in range(20_000)), "b"]
    got = {r.cell: r.features for r in models.features(m, genes).collect()}
    assert got[1].size == 20_002 and got[1].indices.tolist() == [0, 20_001] and got[1].values == pytest.approx(np.log1p([250.0, 750.0]))
    assert got[2].size == 20_002 and got[2].numNonzeros() == 0


@pytest.fixture(scope="module")
def wide(spark):
    """Rows of few values over 300 columns, most of which are rare; the same as a matrix."""
    rng = np.random.default_rng(3)
    x = rng.poisson(np.r_[rng.uniform(0.2, 2, 40), np.full(260, 0.02)], (400, 300)).astype(float)
    x[:200, :10] *= 3
    x[7] = 0
    rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, i array<int>, v array<double>")


def test_axes_of_sparse_rows_against_numpy(wide):
    x, rows = wide
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    k = components.components_to_keep(w[::-1] / w.sum())
    axes, mean = components.principal_axes(rows, 300)
    assert axes.shape == (300, k) and mean == pytest.approx(x.mean(0))
    assert np.abs((axes * v[:, ::-1][:, :k]).sum(0)) == pytest.approx(np.ones(k))
    a, b = np.nonzero(np.triu(x.T @ x))
    for heavy in (64, 200):
        again = components.leading_axes(a, b, (x.T @ x)[a, b] / 400, mean, dense=10, heavy=heavy)
        assert again.shape == axes.shape and np.abs((again * axes).sum(0)) == pytest.approx(np.ones(k), abs=1e-6)
    got = {r.id: r.vec for r in components.on_axes(rows, axes, mean, "id").collect()}
    assert np.array([got[i] for i in range(400)]) == pytest.approx((x - mean) @ axes, abs=1e-4)


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 40))
    x[30] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for skip in (True, False):
        found = components.nearest(df, df.withColumnRenamed("id", "qid"), 7, skip_self=skip).toPandas().sort_values(["qid", "d", "id"])
        want = d + np.diag(np.full(900, np.inf)) if skip else d
        assert np.array(found.d).reshape(900, 7) == pytest.approx(np.sort(want, 1)[:, :7], abs=1e-2)
        assert [set(g) for g in np.array(found.id).reshape(900, 7)[100:]] == [set(g) for g in np.argsort(want, 1, kind="stable")[100:, :7]]
    assert components.nearest(df.where("id < 3"), df.withColumnRenamed("id", "qid"), 7).count() == 2700
    assert components.nearest(df.where("false"), df.withColumnRenamed("id", "qid"), 7).count() == 0


def test_types_come_from_the_nearest_reference_cells(spark):
    rng = np.random.default_rng(2)
    side = lambda n, at: [(at + i, f"g{g}", int(c)) for i in range(n) for g, c in enumerate(rng.poisson(np.where(np.arange(50) // 25 == i % 2, 4, 0.2))) if c]
    ref, query = (spark.createDataFrame(side(n, at), "cell long, gene string, n long") for n, at in ((40, 0), (400, 1000)))
    typed = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "cell long, type string")
    got = {r.cell: (r.type, r.share) for r in models.transfer_labels(ref, typed, query, [f"g{g}" for g in range(50)], 15).collect()}
    assert len(got) == 400 and all(t == "ab"[c % 2] and round(share * 15, 6) % 1 == 0 for c, (t, share) in got.items())


def test_negative_binomial(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f"g{g}", int(rng.negative_binomial(20, 20 / (20 + 100 * (1 + s % 2) * (4 if g == 0 and s >= 6 else 1))))) for s in range(12) for g in range(40)]
    m = spark.createDataFrame(rows, "sample long, gene string, n long")
    samples = spark.createDataFrame([(s, int(s >= 6)) for s in range(12)], "sample long, condition int")
    got = {r.gene: r for r in negative_binomial_test(m, samples).collect()}
    assert len(got) == 40 and abs(got["g0"].log2_fold_change - 2) < 0.3 and got["g0"].padj < 1e-6
    assert np.mean([got[f"g{g}"].pvalue < 0.05 for g in range(1, 40)]) < 0.3 and all(abs(got[f"g{g}"].log2_fold_change) < 0.7 for g in range(1, 40))
    assert negative_binomial_test(m, samples.where("condition = 1")).count() == 0
    assert negative_binomial_test(m.where("false"), samples).count() == 0


def test_sample_cap_keeps_rows_once(spark):
    from conftest import DATA

    from cellwright.plans import registry

    got = registry.QUERIES["sample_cap"](spark, DATA)
    assert got.count() == min(10_000, got.select("id").distinct().count()) > 0


def test_spread(spark):
    from cellwright.runtime import spread

    df = spark.range(100, numPartitions=4)
    assert spread(df, 3, "id").rdd.getNumPartitions() == 4 and spread(df, 9, "id").rdd.getNumPartitions() == 9
    assert spread(df, 9, "id").distinct().count() == 100
