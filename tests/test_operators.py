"""Operators that SQL can't check: hand fixtures, brute force and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from cellwright.operators import geometry as geo
from cellwright.operators import segmentation as seg
from cellwright.operators.filters import filter_transcripts
from cellwright.operators.graph import components, neighbour_clusters
from cellwright.operators.knn import nearest_marked, spatial_knn
from cellwright.operators.markers import benjamini_hochberg, two_sided_t
from cellwright.operators.matrix import downsample, knee_of_totals, kneepoint, normalize_total, zscore
from cellwright.operators.models import components_to_keep
from cellwright.operators.proximity import nearby
from cellwright.operators.tables import average_rank, literal_list, quantiles
from cellwright.plans import registry
from cellwright.sources.store import first_match


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def _tx(spark):
    rows = [("a1", "b1", 1)] * 6 + [("a1", "b1", 0)] * 2 + [("a1", "b2", 0)] * 4 + [("a2", "b1", 0)] * 2 + [("a2", "b2", 1)] * 3 + [("a2", "b2", 0)] * 7
    return spark.createDataFrame([(*r, 1.0) for r in rows], "a string, b string, pos int, score double")


def test_segmentation_fixture(spark):
    tx = _tx(spark)
    got = {r.cell: (r.jaccard, r.purity, r.recall) for r in seg.agreement(tx).collect()}
    assert got == {"a1": (8 / 14, 8 / 12, 8 / 10)}
    assert [tuple(r) for r in seg.contamination(tx).collect()] == [("a1", 0.5)]
    assert {tuple(r) for r in seg.overlap(tx).collect()} == {("b1", 1), ("b2", 0)}
    assert {tuple(r) for r in seg.overlap(tx, score="score").collect()} == {("b1", 1), ("b2", 2)}


def test_small_fixtures(spark):
    f = spark.createDataFrame([("ACTA2", 30.0), ("ACTA2", 29.9), ("BLANK_1", 40.0), ("antisense_X", 40.0), ("xBLANK_1", 40.0)], "feature_name string, qv double")
    assert [r.feature_name for r in filter_transcripts(f).collect()] == ["ACTA2", "xBLANK_1"]
    m = spark.createDataFrame([("a", "g", 2), ("b", "g", 4), ("c", "g", 6)], "cell string, gene string, n long")
    assert {r.norm for r in normalize_total(m).collect()} == {4.0}
    assert {r.cell: r["sum(n)"] for r in downsample(m, 3).groupBy("cell").sum("n").collect()} == {"a": 2, "b": 3, "c": 3}
    z = spark.createDataFrame([("a", "g", 0), ("b", "g", 0), ("c", "g", 2)], "cell string, gene string, n long")
    assert [round(r.z, 6) for r in zscore(z, "n").orderBy("cell").collect()] == [-0.707107, -0.707107, 1.414214]
    for values, at in (([0, 0.8, 0.9, 1], 1), ([1, 0.9, 0.8, 0], 2)):
        assert kneepoint(spark.createDataFrame(list(enumerate(map(float, values))), "i int, v double"), "i", "v").first().idx == at
    ranks = average_rank(spark.createDataFrame([("x", 2), ("x", 4), ("y", 1), ("y", 2)], "k string, v int").withColumn("g", F.lit(1)), "v", ["g"], "r")
    assert sorted((r.v, r.r) for r in ranks.collect()) == [(1, 1.0), (2, 2.5), (2, 2.5), (4, 4.0)]
    p = spark.createDataFrame([("g", x) for x in (0.01, 0.02, 0.03, 0.5)], "g string, p double")
    assert [round(r.q, 9) for r in benjamini_hochberg(p, ["g"], "p", "q").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_geometry_fixtures():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]], float)
    h = geo.hull(square)
    assert geo.perimeter_of(h) == 4 and geo.area_of(h) == 1
    assert geo.widest_gap(square) == pytest.approx(math.sqrt(0.5))
    (ring,) = geo.outline(square)
    assert geo.area_of(ring) == pytest.approx(1) and len(ring) == 4
    assert geo.outline(square[:2]) == []
    pts = np.random.default_rng(0).normal(size=(60, 2))
    area = sum(geo.area_of(pts[list(t)]) for t in geo.delaunay(pts))
    assert area == pytest.approx(geo.area_of(geo.hull(pts)), rel=1e-3)
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 2]], float)
    assert len(geo.simplify(line, 0.1)) == 3


def test_knn_against_brute_force(spark):
    rng = random.Random(0)
    pts = [("f", i, round(rng.gauss(0, 1) ** 3 * 50 + 500, 1), round(rng.uniform(0, 900), 1)) for i in range(2500)] + [("few", 9000, 1.0, 1.0), ("few", 9001, 4.0, 5.0), (None, 9002, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "frame string, id long, x double, y double").where("frame IS NOT NULL")
    got = {}
    for r in spatial_knn(df, 7, tile_points=100).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.nb
    by = {}
    for f, i, x, y in pts:
        by.setdefault(f, []).append((i, x, y))
    for f in ("f", "few"):
        for i, x, y in by[f]:
            want = [j for _, j in sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in by[f])[:7]]
            assert [got[i][k] for k in sorted(got[i])] == want


def test_nearby_edges(spark):
    rng = random.Random(1)
    pts = [("d", i, rng.uniform(0, 30), rng.uniform(0, 30), "x") for i in range(1500)] + [("d", 5000, 3.0, 3.0, "x"), ("d", 5000, 3.0, 3.0, "x"), ("d", 5001, 3.0, 3.0, "x"), ("d", 5002, -1.0, 3.0, "x"), ("d", 5003, None, 3.0, "x"), ("d", 5004, math.nan, 3.0, "x"), (None, 5005, 3.0, 3.0, "x"), ("e", 5006, 3.0, 3.0, "x"), ("d", None, 3.0, 3.0, "x")]
    box = [("d", "r", 2, 8.0, 8.0), ("d", "r", 0, 2.0, 2.0), ("d", "r", 1, 8.0, 2.0), ("d", "r", 1, 8.0, 2.0), ("d", "r", 3, 2.0, 8.0), ("d", "r", 4, 2.0, 2.0), ("d", "r", 5, None, 2.0), ("d", "two", 0, 0.0, 0.0), ("d", "two", 1, 30.0, 30.0), ("d", None, 1, 30.0, 30.0)]
    p = spark.createDataFrame(pts, "frame string, id long, x double, y double, match string")
    c = spark.createDataFrame(box, "frame string, region string, no int, x double, y double")
    run = lambda a, b: {tuple(r) for r in nearby(a, b, 0.5, id_col="id", frame="frame", x="x", y="y", region="region", order="no", vx="x", vy="y", strip_points=40).collect()}
    ok = {(f, i): (x, y) for f, i, x, y, _ in pts if f and i is not None and x is not None and x >= 0}
    want = {("near", i, str(j)) for (f, i), a in ok.items() for (g, j), b in ok.items() if f == g and i < j and math.dist(a, b) <= 0.5}
    want |= {("inside", i, "r") for (f, i), (x, y) in ok.items() if f == "d" and 2 < x < 8 and 2 < y < 8}
    assert run(p, c) == want
    assert run(p.where("false"), c) == set() and {k for k, _, _ in run(p, c.where("false"))} == {"near"}


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    from types import SimpleNamespace

    from cellwright.runtime import shared_dir

    conf = lambda named: SimpleNamespace(get=lambda key: named)
    session = lambda master, named: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(named)))
    assert shared_dir(session("spark://host", "hdfs:/x")) == "hdfs:/x"
    for master in ("spark://host", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master, None))


def test_quantiles_and_ranks_by_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 500)] + [("b", float(v)) for v in rng.normal(size=301)] + [("b", None), ("c", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q1, r.q9) for r in quantiles(df, "v", {"q1": 0.25, "q9": 0.9}, ["k"]).collect()}
    for k in "abc":
        v = [x for g, x in rows if g == k and x is not None]
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.25, 0.9])))
    one = quantiles(df, "v", {"m": 0.5}, []).first()
    assert one.m == pytest.approx(np.median([x for _, x in rows if x is not None])) and quantiles(df.where("false"), "v", {"m": 0.5}, []).count() == 0


def test_students_t(spark):
    # known values: t = 2.228, 10 degrees: 0.05; 1 degree is the Cauchy distribution; many degrees are the normal one
    rows = [(2.2281388519649385, 10.0), (1.0, 1.0), (-1.959963984540054, 1e9), (0.0, 5.0), (40.0, 30.0), (None, 3.0), (1.0, None)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, df double").coalesce(1).select(two_sided_t("t", "df").alias("p")).collect()]
    assert got[:4] == pytest.approx([0.05, 0.5, 0.05, 1.0], abs=1e-6) and got[4] < 1e-25 and got[5:] == [None, None]


def test_knee_of_totals_is_the_knee_of_all_cells(spark):
    rng = np.random.default_rng(2)
    totals = np.r_[rng.integers(1, 6, 300), rng.integers(20, 400, 200)]
    v = np.log10(np.sort(totals))
    off = np.abs((len(v) - 1) * (v - v[0]) - (v[-1] - v[0]) * np.arange(len(v)))
    df = spark.createDataFrame([(int(t),) for t in totals], "total long")
    assert knee_of_totals(df, "total").first().value == np.sort(totals)[off.round(9).argmax()] and knee_of_totals(df.where("false"), "total").count() == 0


def test_literal_list(spark):
    said = ["['a', 'b c']", '["x, y", \'z\']', "[]", "no list", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in said], "t string").coalesce(1).select(literal_list(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b c"], ["x, y", "z"], [], None, None]


def test_first_match(spark):
    assert first_match(spark, f"{DATA}/c*.parquet").endswith("cell_boundaries.parquet")
    with pytest.raises(FileNotFoundError):
        first_match(spark, f"{DATA}/nothing*.parquet")


def test_nearest_marked_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [("f", i, float(x), float(y), bool(i % 40 == 0)) for i, (x, y) in enumerate(rng.normal(size=(700, 2)) ** 3 * 50 + 500)] + [("f", 900, pts0, 1.0, True) for pts0 in (1.0,)] + [("f", 901, 1.0, 1.0, True), ("few", 950, 0.0, 0.0, True), ("few", 951, 3.0, 4.0, None)]
    got = {r.id: r.d2 for r in nearest_marked(spark.createDataFrame(pts, "frame string, id long, x double, y double, mark boolean"), 60).collect()}
    for f, i, x, y, _ in pts:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j, m) for g, j, u, v, m in pts if g == f)[:60]
        want = next((d for d, _, m in near if m and d > 0), None)
        assert got[i] == (None if want is None else pytest.approx(want))


def test_components_to_keep():
    shares = [0.5, 0.3, 0.1, 0.05, 0.03, 0.02]
    assert components_to_keep(shares) == 1 and components_to_keep(shares, 0.9) == 2 and components_to_keep([1.0]) == 1


def test_big_cell_is_outlined():
    pts = np.random.default_rng(9).uniform(size=(20_000, 2))
    (ring,) = geo.outline(pts)
    assert 0.9 < geo.area_of(ring) <= 1.0


def test_neighbour_clusters_find_groups(spark):
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(4, 10)) * 8, 60, 0) + rng.normal(size=(240, 10))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>")
    of = {r.id: r.label for r in neighbour_clusters(df, 15).collect()}
    assert all(of[i] != of[j] for i in range(0, 240, 60) for j in range(0, 240, 60) if i != j) and len(set(of.values())) < 20
    assert len({r.label for r in neighbour_clusters(df, 15, resolution=8.0).collect()}) >= len(set(of.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1002, 1000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000, 1002: 1000}
