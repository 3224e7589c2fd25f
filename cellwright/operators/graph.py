"""Graphs as edge tables: neighbour overlap, modularity communities, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.components import nearest
from cellwright.operators.descent import BLOCK, _curve, neighbour_descent
from cellwright.runtime import cut, drop, parts

#: What a round must add to a group's modularity to count as a rise.
RISE = 1e-4
#: Edges, each in both directions, of a group that one task finishes.
SMALL = 100_000
#: The same where single nodes should move through the whole graph, not only inside blocks of it.
WHOLE = 2_000_000
#: Dimensions beyond which neighbours are found by comparing all with all: descent would send each vector with each edge.
WIDE = 32


def jaccard_edges(knn: DataFrame) -> DataFrame:
    """(u, v, w), u < v: shared neighbours over all neighbours of the two ends of each edge of (id, nb) lists.

    Lists hold k ids, so the intersection is one join on the neighbour, pre-filtered by the edges asked for.
    """
    lists = knn.groupBy("id").agg(F.collect_set("nb").alias("nbs"))  # k ids
    edges = knn.where("id <> nb").select(F.least("id", "nb").alias("u"), F.greatest("id", "nb").alias("v")).distinct()
    both = edges.join(lists.withColumnRenamed("id", "u").withColumnRenamed("nbs", "a"), "u").join(lists.withColumnRenamed("id", "v").withColumnRenamed("nbs", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", (shared.cast("double") / (F.size("a") + F.size("b") - shared)).alias("w"))


def mutual_jaccard(near: DataFrame) -> DataFrame:
    """(u, v, w), u <= v: shared neighbours over all neighbours of the ends of each edge of (u, v), where both ends of an edge are
    neighbours of each other and all of themselves.

    A point may be near to many: of the two lists only the shorter one is sent with the edge.
    """
    one_way = near.where("u <> v").select(F.col("u").alias("id"), F.col("v").alias("nb"))
    ends = cut(one_way.unionByName(one_way.select(F.col("nb").alias("id"), F.col("id").alias("nb"))).distinct())
    lists = cut(ends.groupBy("id").agg(F.collect_list("nb").alias("nbs")).select("id", F.array_append("nbs", F.col("id")).alias("nbs")))
    size = lambda c, n: lists.select(F.col("id").alias(c), F.size("nbs").alias(n))
    e = ends.where("id < nb").select(F.col("id").alias("u"), F.col("nb").alias("v")).join(size("u", "nu"), "u").join(size("v", "nv"), "v")
    less = F.col("nu") <= F.col("nv")
    e = e.select("u", "v", "nu", "nv", F.when(less, F.col("u")).otherwise(F.col("v")).alias("low"), F.when(less, F.col("v")).otherwise(F.col("u")).alias("high"))
    told = e.join(lists.select(F.col("id").alias("low"), F.col("nbs").alias("a")), "low").join(lists.select(F.col("id").alias("high"), F.col("nbs").alias("b")), "high")
    shared = F.size(F.array_intersect("a", "b"))
    loops = lists.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))
    return told.select("u", "v", (shared.cast("double") / (F.col("nu") + F.col("nv") - shared)).alias("w")).unionByName(loops)


def communities(nodes: DataFrame, edges: DataFrame, small: int = SMALL, resolution: float = 1.0) -> DataFrame:
    """(loc, c): modularity communities. ``nodes``: loc, g; ``edges``: g, u, v, w in both directions, loops once.

    Rounds go on until a group's modularity has risen by no more than ``RISE`` in two of them, with the best labels kept;
    levels until one unites nothing. A group of at most ``small`` edges, given or left by a level, is finished in one task.
    Edges may name a ``block`` of their ``u``, a part of its group that fits into a task: then every block finds its own
    communities first, with degrees and weight of the whole graph, and the further levels unite them across blocks. A
    ``resolution`` above 1 asks for smaller communities.
    """
    member = cut(nodes.select("loc", F.col("loc").alias("c")))
    weight = cut(edges.groupBy("g").agg(F.sum("w").alias("all")))
    work, level = edges.select("g", "u", "v", "w"), 0
    if "block" in edges.columns:
        label = cut(_inside(edges.select("g", "block", "u", "v", "w"), weight, resolution))
        wide = edges.groupBy("g").agg((F.max("block") > F.min("block")).alias("wide")).where("wide").select("g")
        work = cut(_fold(work.join(wide, "g", "left_semi"), label))
        member = _follow(member, label)
        drop(label)
    while not work.isEmpty():
        size = cut(work.groupBy("g").agg(F.count("*").alias("n")))
        few, many = (size.where(f"n {op} {small}").select("g") for op in ("<=", ">"))
        done = _inside(work.join(few, "g", "left_semi").withColumn("block", F.lit(0)), weight, resolution)
        big = work.join(many, "g", "left_semi")
        moved = None if many.isEmpty() else _moves(big, weight.join(many, "g", "left_semi"), level, resolution)
        label = cut(done if moved is None else done.unionByName(moved))
        member, folded = _follow(member, label), None
        if moved is not None:
            live = cut(moved.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("c").alias("m")).where("m < n").select("g"))  # the other groups are done
            folded = cut(_fold(big.join(live, "g", "left_semi"), moved))
            drop(live)
            drop(moved)
        for old in (label, size, work):  # the caller's edges stay
            drop(old)
        if folded is None:
            break
        work, level = folded, level + 1
    drop(weight)
    return member


def _follow(member: DataFrame, label: DataFrame) -> DataFrame:
    """Members with the label that their community was given."""
    grown = cut(member.join(label.select(F.col("n").alias("c"), F.col("c").alias("up")), "c", "left").select("loc", F.coalesce("up", "c").alias("c")))
    drop(member)
    return grown


def _fold(work: DataFrame, label: DataFrame) -> DataFrame:
    """Edges between labels, with the sums of their weights; inner edges become loops."""
    up = lambda s: label.select(F.col("n").alias(s), F.col("c").alias(f"c{s}"))
    return work.join(up("u"), "u").join(up("v"), "v").groupBy("g", F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))


def _inside(edges: DataFrame, weight: DataFrame, resolution: float) -> DataFrame:
    """(n, g, c): the communities that each block of (g, block, u, v, w) finds in one task."""
    rows = edges.join(weight, "g").select("g", "block", "u", "v", "w", "all")
    return rows.repartition(parts(edges.sparkSession), "g", "block").groupBy("g", "block").applyInPandas(_finish(resolution), "n long, g long, c long")


def _finish(resolution: float):
    """(n, g, c) of one block: single nodes move in turn, then their communities, until nothing more is gained."""
    import pandas as pd

    def run(t):
        u, v, w = (t[c].to_numpy() for c in ("u", "v", "w"))
        ids, u = np.unique(u, return_inverse=True)
        label, n, total, deg = np.arange(len(ids)), len(ids), float(t["all"].iloc[0]), np.bincount(u, w)
        at = np.minimum(np.searchsorted(ids, v), n - 1)
        here = ids[at] == v
        u, v, w = u[here], at[here], w[here]
        while True:
            names, step = np.unique(_pass_nodes(u, v, w, deg, total / resolution), return_inverse=True)
            label, m = step[label], len(names)
            if m == n:
                break
            deg = np.bincount(step, deg, m)
            key, at = np.unique(step[u] * m + step[v], return_inverse=True)
            u, v, w, n = key // m, key % m, np.bincount(at, w, len(key)), m
        least = ids[np.unique(label, return_index=True)[1]]  # ids rise, so the first is the smallest
        return pd.DataFrame({"n": ids, "g": t["g"].iloc[0], "c": least[label]})

    return run


def _pass_nodes(u, v, w, degree, total: float) -> list[int]:
    """Labels of the nodes after passes over all of them in order, each moved to the community of largest gain.

    A node is looked at again only while one of its neighbours has moved.
    """
    deg, n = degree.tolist(), len(degree)
    order = np.lexsort((v, u))
    order = order[u[order] != v[order]]
    first = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    to, weight = v[order].tolist(), w[order].tolist()
    c, tot, rise, stale = list(range(n)), list(deg), 1.0, [True] * n
    while rise > 1e-7:
        rise = 0.0
        for i in range(n):
            if not stale[i]:
                continue
            stale[i], a, b = False, first[i], first[i + 1]
            now, toward = c[i], {c[i]: 0.0}
            for j in range(a, b):
                k = c[to[j]]
                toward[k] = toward.get(k, 0.0) + weight[j]
            if len(toward) == 1:
                continue
            mine = deg[i] / total
            tot[now] -= deg[i]
            stay = best = round(toward[now] - mine * tot[now], 9)
            where = now
            for k, x in toward.items():
                gain = round(x - mine * tot[k], 9)
                if gain > best or (gain == best and where != now and k < where):
                    best, where = gain, k
            tot[where] += deg[i]
            if where != now:
                c[i] = where
                rise += 2 * (best - stay) / total
                for j in range(a, b):
                    stale[to[j]] = True
    return c


def _moves(work: DataFrame, weight: DataFrame, level: int, resolution: float) -> DataFrame:
    """(n, g, c): the nodes of one level with the labels of highest modularity that the rounds came to."""
    degree = cut(work.groupBy("g", "u").agg(F.sum("w").alias("deg")))  # loops count, as weight inside
    label = cut(degree.select(F.col("u").alias("n"), "g", F.col("u").alias("c"), F.col("u").alias("top")))
    state = cut(weight.select("g", F.lit(float("-inf")).alias("q"), F.lit(0).alias("stale")))
    r = 0
    while True:
        going = state.where("stale < 2").select("g")
        own = degree.join(label.select(F.col("n").alias("u"), "c", "top"), "u")
        total = own.groupBy("c").agg(F.sum("deg").alias("tot"))
        toward = work.where("u <> v").join(going, "g", "left_semi").join(label.select(F.col("n").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        mine = own.join(going, "g", "left_semi").select("u", "g", "deg", F.col("c").alias("now"), "top")
        options = toward.unionByName(mine.select("u", F.col("now").alias("c"), F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
        options = options.join(mine, "u").join(total, "c").join(weight, "g")
        here = F.col("c") == F.col("now")
        gain = F.col("w") - resolution * F.col("deg") * (F.col("tot") - F.when(here, F.col("deg")).otherwise(0.0)) / F.col("all")
        # what the labels of this round are worth: weight inside, without loops, less what the degrees of a community let expect
        worth = F.max(F.when(here, (F.col("w") - resolution * F.col("deg") * F.col("tot") / F.col("all")) / F.col("all")))
        best = options.groupBy("u", "g", "now", "top").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), (-F.col("c")).alias("minus"))).alias("b"), worth.alias("q"))
        # halves move in turn, so that two never just swap; they are drawn anew for every two rounds
        turn = F.pmod(F.xxhash64("u", F.lit(level), F.lit(r // 2)), F.lit(2)) == r % 2
        moved = cut(best.select(F.col("u").alias("n"), "g", "now", "top", F.when(turn, -F.col("b.minus")).otherwise(F.col("now")).alias("c"), "q"))
        seen = moved.groupBy("g").agg(F.sum("q").alias("new")).join(state, "g", "right")
        rise = F.coalesce(F.col("new") > F.col("q") + RISE, F.lit(False))
        after = cut(seen.select("g", F.when(rise, F.col("new")).otherwise(F.col("q")).alias("q"), F.when(rise, 0).otherwise(F.col("stale") + 1).alias("stale"), rise.alias("rise")))
        kept = label.select("n", "g", F.col("c").alias("now"), "top").join(state.where("stale >= 2").select("g"), "g", "left_semi")
        rows = moved.select("n", "g", "now", "top", "c").unionByName(kept.withColumn("c", F.col("now")))
        fresh = cut(rows.join(after.select("g", "rise"), "g").select("n", "g", "c", F.when(F.col("rise"), F.col("now")).otherwise(F.col("top")).alias("top")))
        for old in (label, moved, state):
            drop(old)
        label, state, r = fresh, after.select("g", "q", "stale"), r + 1
        state._cellwright_path = after._cellwright_path
        if state.where("stale < 2").isEmpty():
            drop(state)
            drop(degree)
            out = cut(label.select("n", "g", F.col("top").alias("c")))
            drop(label)
            return out


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) by large-star and small-star contraction; root is the smallest node."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # what lies below u now points to the smallest of it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def size_labels(member: DataFrame, least: int) -> DataFrame:
    """(loc, label): communities numbered by falling size; those of at most ``least`` members get -1."""
    sizes = member.groupBy("c").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "c")  # one row per community
    return member.join(sizes.withColumn("label", F.when(F.col("n") <= least, -1).otherwise(F.row_number().over(w) - 1)).select("c", "label"), "c").select("loc", "label")


def _wide_graph(rows: DataFrame, box: DataFrame, dim: int, k: int) -> DataFrame:
    """(u, v, d, block) of rows of many dimensions: their exact neighbours; blocks are sections of a curve."""
    near = nearest(rows.select(F.col("loc").alias("id"), F.col("vec").alias("v")), rows.select(F.col("loc").alias("qid"), F.col("vec").alias("v")), k, skip_self=True)
    return cut(near.select(F.col("qid").alias("u"), F.col("id").alias("v"), "d").join(_curve_blocks(rows, box, dim), "u"))


def _curve_blocks(rows: DataFrame, box: DataFrame, dim: int) -> DataFrame:
    """(u, block): sections of a curve through the rows."""
    curve = rows.crossJoin(F.broadcast(box)).mapInArrow(_curve(dim), "g long, loc long, vec array<double>, n int, z long").where("n = 0").select("loc", "z")
    return cut(curve.repartitionByRange(-(-rows.count() // BLOCK) or 1, "z", "loc").select(F.col("loc").alias("u"), F.spark_partition_id().cast("long").alias("block")))


def _box(rows: DataFrame, dim: int) -> DataFrame:
    return rows.agg(*(F.array(*(f(F.col("vec")[i]) for i in range(dim))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))))


def neighbour_clusters(v: DataFrame, k: int, resolution: float = 1.0, least: int = -1) -> DataFrame:
    """(id, label) of vectors (id, v): communities of the overlap-weighted graph of about the k nearest neighbours (exactly these in many dimensions), by falling size."""
    rows = cut(v.select(F.lit(0).cast("long").alias("g"), F.col("id").alias("loc"), F.col("v").cast("array<double>").alias("vec")).dropna())
    dim = rows.select(F.max(F.size("vec"))).first()[0] or 1
    box = _box(rows, dim)
    near = _wide_graph(rows, box, dim, k) if dim > WIDE else neighbour_descent(rows.crossJoin(F.broadcast(box)), dim, k, width=max(k, 20))
    lists = near.select(F.col("u").alias("id"), F.col("v").alias("nb")).unionByName(rows.select(F.col("loc").alias("id"), F.col("loc").alias("nb")))
    e = cut(jaccard_edges(lists))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    block = near.groupBy("u").agg(F.max("block").alias("block"))
    work = cut(both.join(block, "u", "left").select(F.lit(0).cast("long").alias("g"), "u", "v", "w", F.coalesce("block", F.lit(-1)).alias("block")))
    return size_labels(communities(rows.select("loc", "g"), work, resolution=resolution), least).withColumnRenamed("loc", "id")


def near_clusters(v: DataFrame, near: DataFrame, resolution: float = 1.0, least: int = -1, whole: int = WHOLE) -> DataFrame:
    """(id, label) of vectors (id, v): communities, by falling size, of the graph of their neighbours (u, v) weighted by
    :func:`mutual_jaccard`. Up to ``whole`` edges one task moves every node; more are found inside blocks of a curve first.
    """
    rows = v.select(F.lit(0).cast("long").alias("g"), F.col("id").alias("loc"), F.col("v").cast("array<double>").alias("vec"))
    e = cut(mutual_jaccard(near))
    both = e.unionByName(e.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).select(F.lit(0).cast("long").alias("g"), "u", "v", "w")
    if 2 * e.count() > whole:
        dim = rows.select(F.max(F.size("vec"))).first()[0] or 1
        both = both.join(_curve_blocks(rows, _box(rows, dim), dim), "u")
    found = communities(rows.select("loc", "g"), cut(both), small=whole, resolution=resolution)
    drop(e)
    return size_labels(found, least).withColumnRenamed("loc", "id")
