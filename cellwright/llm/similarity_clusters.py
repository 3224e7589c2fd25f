"""Clusters of mutually similar records, with their size and most typical members.

Method: neighbour descent (:mod:`cellwright.operators.descent`) builds an approximate k-nearest-neighbour graph, in blocks of
two shifted Morton curves first and then in rounds over the whole table until few changes are left. Vectors travel only to the records whose neighbourhoods are compared, not on edges.

Modularity-based community detection then moves records to the community of largest gain, first inside blocks, then whole
communities across them; members with the highest weighted degree inside their cluster describe it.

Where clusters are defined by a radius (records at most ``radius`` apart belong together, and so do chains of them),
communities that edges of the graph link are united by distributed star contraction. An exact check follows: it looks for
pairs within ``radius`` of two different clusters, which the graph may miss as it holds only the k nearest, and unites
these too. The column ``part`` keeps the cluster before that check.

Defined results: a null id, group part or vector, or an unusable one (wrong length, null, NaN, infinite) takes no part;
ids that come twice count once; records at one place are one node of the graph and stay together; ties go to the smaller
id; an empty table gives no rows. Cluster ids are the smallest id inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.descent import neighbour_descent
from cellwright.operators.graph import communities, components
from cellwright.runtime import cut, parts, runs

def _links(radius: float):
    def run(batches):
        for t in runs(batches, "key"):
            key, x, y, c, home, g = (t[n].to_numpy(zero_copy_only=False) for n in ("key", "x", "y", "c", "home", "g"))
            order = np.lexsort((x, key))
            key, x, y, c, home, g = (v[order] for v in (key, x, y, c, home, g))
            lag, i, seen = 1, np.arange(len(key)), []
            while True:
                i = i[i + lag < len(key)]
                i = i[(key[i] == key[i + lag]) & (x[i + lag] - x[i] <= radius)]
                if not len(i):
                    break
                j = i + lag
                ok = (home[i] | home[j]) & (c[i] != c[j]) & (g[i] == g[j]) & ((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= radius * radius)
                if ok.any():
                    seen.append(np.unique(np.stack([np.minimum(c[i[ok]], c[j[ok]]), np.maximum(c[i[ok]], c[j[ok]])], 1), axis=0))
                lag += 1
            if seen:
                pairs = np.unique(np.vstack(seen), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def radius_links(points: DataFrame, radius: float) -> DataFrame:
    """(a, b): clusters of one group with two members at most ``radius`` apart. ``points``: g, c, x, y.

    Points are tiled; a tile also gets the points within ``radius`` left of and below its neighbours' edges.
    """
    n, side = parts(points.sparkSession, 4), 8 * radius
    tile = lambda v: F.floor(F.col(v) / side)
    over = lambda v: F.when(F.col(v) <= tile(v) * side + radius, F.array(tile(v), tile(v) - 1)).otherwise(F.array(tile(v)))
    placed = points.select("g", "c", "x", "y", F.explode(over("x")).alias("tx"), over("y").alias("ty")).select("g", "c", "x", "y", "tx", F.explode("ty").alias("ty"))
    placed = placed.select(F.xxhash64("g", "tx", "ty").alias("key"), "g", "x", "y", "c", ((F.col("tx") == tile("x")) | (F.col("ty") == tile("y"))).alias("home"))
    return placed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long").distinct()


def similarity_clusters(df: DataFrame, id_col: str, vector: str, group: list[str], dim: int, *, k: int = 8, radius: float = float("inf")) -> tuple[DataFrame, DataFrame]:
    """(members: cluster, size, part, community, id, degree) and (edges of the graph: g, u, v, w); see the module's text.

    With a finite ``radius`` (two dimensions) clusters are unions of communities; else they are the communities.
    """
    v = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group)), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    rows = rows.dropna().where((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.select("id", F.xxhash64(*(f"_g{i}" for i in range(len(group))), F.lit(5)).alias("g"), "vec")
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("g", "vec")).alias("r")).select("id", "r.g", "r.vec"))
    places = cut(rows.groupBy("g", "vec").agg(F.min("id").alias("loc"), F.count("*").alias("n")))
    box = [F.array(*(f(v[i]) for i in range(dim))) for f in (F.min, F.max)]
    boxes = places.groupBy("g").agg(box[0].alias("low"), box[1].alias("high"))
    near = neighbour_descent(places.join(boxes, "g").select("g", "loc", "vec", "low", "high"), dim, k, radius)
    scale = F.lit(radius) if radius < float("inf") else F.lit(near.agg(F.avg("d")).first()[0] or 1.0)
    turned = near.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", F.lit(-1).cast("long").alias("block"))
    both = near.select("u", "v", "d", "block").unionByName(turned).groupBy("u", "v").agg((1 / (1 + F.first("d") / scale)).alias("w"), F.max("block").alias("block"))
    own = near.groupBy("u").agg(F.max("block").alias("own"))
    graph = both.join(places.select(F.col("loc").alias("u"), "g"), "u").join(own, "u", "left").select("g", "u", "v", "w", F.coalesce("own", "block").alias("block"))
    graph = cut(graph)
    member = communities(places, graph)
    named = lambda s: member.select(F.col("loc").alias(s), F.col("c").alias(f"c{s}"))
    if radius < float("inf"):
        between = graph.select("u", "v").where("u < v").join(named("u"), "u").join(named("v"), "v").where("cu <> cv").select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b"))
        united = components(between.distinct()).withColumnRenamed("node", "c")
        member = cut(member.join(united, "c", "left").select("loc", "c", F.coalesce("root", "c").alias("part")))
        where = places.join(member, "loc").select("g", F.col("part").alias("c"), v[0].alias("x"), v[1].alias("y"))
        roots = components(radius_links(where, radius)).withColumnRenamed("node", "part")
        member = cut(member.join(roots, "part", "left").select("loc", "c", "part", F.coalesce("root", "part").alias("root")))
    else:
        member = cut(member.withColumn("part", F.col("c")).withColumn("root", F.col("c")))
    inside = graph.join(member.select(F.col("loc").alias("u"), F.col("root").alias("ru")), "u").join(member.select(F.col("loc").alias("v"), F.col("root").alias("rv")), "v")
    degree = inside.where("ru = rv").groupBy(F.col("u").alias("loc")).agg(F.sum("w").alias("degree"))
    held = rows.join(places.select("g", "vec", "loc"), ["g", "vec"]).join(member, "loc").join(degree, "loc", "left")
    sizes = member.join(places.select("loc", "n"), "loc").groupBy("root").agg(F.min("loc").alias("cluster"), F.sum("n").alias("size"))
    out = held.join(sizes, "root").select("cluster", "size", "part", F.col("c").alias("community"), "id", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    return out, graph


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, communities, parts, typical): how many communities it unites, how many parts the graph had left, its ids of highest degree."""
    w = Window.partitionBy("cluster").orderBy(F.desc("degree"), "id")
    top = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    top = top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("typical"))
    sizes = members.groupBy("cluster").agg(F.first("size").alias("size"), F.count_distinct("community").alias("communities"), F.count_distinct("part").alias("parts"))
    return sizes.join(top, "cluster")
