"""Exact nearest neighbours in the plane, within frames, and vector search for stated queries.

The plane is tiled so that a tile holds about ``tile_points`` points. Each tile also receives the points within a margin
around it and answers its own points. An answer is certain if its k-th distance is not larger than the distance to the edge
of what the tile saw; the others go to a further round with a margin twice as large, and what is then left (outliers) asks
all blocks of its frame. So the work follows the points, dense places included, and the result is exact. Ties in distance go to the smaller id; the point itself is neighbour 0 at
distance 0 if ``include_self``. Frames with fewer points give what they have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.runtime import cut, parts

OUT = "id long, nb long, rank int, d2 double"


def _tile(k: int, include_self: bool, marked: bool, cells: int = 4_000_000):
    def run(t: pa.Table) -> pa.Table:
        ids, x, y = (t[c].to_numpy() for c in ("id", "x", "y"))
        ask, far, mark = t["ask"].to_numpy(zero_copy_only=False), t["far"].to_numpy(), t["mark"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        ids, x, y, ask, far, mark = ids[order], x[order], y[order], ask[order], far[order], mark[order]
        rows = np.flatnonzero(ask)
        out: list[tuple] = []
        step = max(1, cells // max(1, len(ids)))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            d = (x[r, None] - x[None]) ** 2 + (y[r, None] - y[None]) ** 2
            if not include_self:
                d[np.arange(len(r)), r] = np.inf
            m = min(k, d.shape[1])
            if m < d.shape[1]:
                kth = np.partition(d, m - 1, 1)[:, m - 1]
                hit_r, hit_c = np.nonzero(d <= kth[:, None])
            else:
                hit_r, hit_c = np.nonzero(np.isfinite(d))
            dd = d[hit_r, hit_c]
            o = np.lexsort((hit_c, dd, hit_r))
            hit_r, hit_c, dd = hit_r[o], hit_c[o], dd[o]
            first = np.searchsorted(hit_r, np.arange(len(r)))
            rank = np.arange(len(hit_r)) - first[hit_r]
            keep = rank < k
            hit_r, hit_c, dd, rank = hit_r[keep], hit_c[keep], dd[keep], rank[keep]
            have = np.bincount(hit_r, minlength=len(r))
            worst = np.zeros(len(r))
            np.maximum.at(worst, hit_r, dd)
            sure = np.where(have >= k, worst <= far[r] ** 2, np.isinf(far[r]))
            ok = sure[hit_r]
            if marked:  # of the k nearest, only the first that is marked and elsewhere; a row without one says so
                ok &= mark[hit_c] & (dd > 0)
                ok[ok] = np.diff(hit_r[ok], prepend=-1) > 0
                none = np.setdiff1d(np.flatnonzero(sure), hit_r[ok])
                out.append((ids[r[none]], np.full(len(none), -1), np.zeros(len(none), np.int32), np.full(len(none), np.inf)))
            out.append((ids[r[hit_r[ok]]], ids[hit_c[ok]], rank[ok].astype(np.int32), dd[ok]))
            lost = np.flatnonzero(~sure)  # asked again with a wider margin
            if len(lost):
                out.append((ids[r[lost]], np.full(len(lost), -1), np.full(len(lost), -1, np.int32), np.full(len(lost), -1.0)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)]
        return pa.table(dict(zip(("id", "nb", "rank", "d2"), cols)))

    return run


def nearest_marked(points: DataFrame, k: int) -> DataFrame:
    """(id, d2) of all points (id, frame, x, y, mark): squared distance to the nearest marked one of the k nearest, those at the same place left out; null if there is none.

    The k neighbours themselves never leave the tasks that find them.
    """
    found = spatial_knn(points, k, tile_points=max(1000, 2 * k), marked=True)
    return found.groupBy("id").agg(F.min("d2").alias("d2")).select("id", F.when(F.col("d2") < float("inf"), F.col("d2")).alias("d2"))


def spatial_knn(points: DataFrame, k: int, *, include_self: bool = True, tile_points: int = 1000, marked: bool = False) -> DataFrame:
    """(id, nb, rank, d2) of all points (id, frame, x, y): the k nearest in their frame, rank from 0, squared distance."""
    spark = points.sparkSession
    n = parts(spark, 4)
    mark = F.coalesce(F.col("mark"), F.lit(False)) if marked else F.lit(False)
    pts = points.select(mark.alias("mark"), F.col("id").cast("long").alias("id"), F.xxhash64("frame").alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    box = pts.groupBy("g").agg(F.count("*").alias("n"), *(f(c).alias(f"{a}{c}") for c in "xy" for f, a in ((F.min, "lo"), (F.max, "hi"))))
    area = F.greatest(F.lit(1e-9), (F.col("hix") - F.col("lox")) * (F.col("hiy") - F.col("loy")))
    side = F.sqrt(area * tile_points / F.greatest(F.col("n"), F.lit(tile_points)))
    side = F.greatest(side, F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")) / 4096, F.lit(1e-6))
    whole = F.col("n") <= tile_points  # a small frame is one tile
    box = cut(box.withColumn("side", side).withColumn("base", F.sqrt(area * (2 * k + 2) / F.col("n"))).withColumn("whole", whole))
    told = cut(pts.join(box.select("g", "side", "base", "whole", "lox", "loy", "hix", "hiy"), "g"))
    asked, out = told.select("id").withColumn("ask", F.lit(True)), []
    tile = lambda v: F.when(F.col("whole"), F.lit(0).cast("bigint")).otherwise(F.floor(v / F.col("side")))
    for widen in (1.0, 2.0, 4.0):
        margin = F.col("base") * widen
        low, high = lambda c: tile(F.greatest(F.col(c) - margin, F.col(f"lo{c}"))), lambda c: tile(F.least(F.col(c) + margin, F.col(f"hi{c}")))
        homes = told.join(asked, "id").select("g", tile(F.col("x")).alias("tx"), tile(F.col("y")).alias("ty")).distinct()
        spread = told.withColumn("tx", F.explode(F.sequence(low("x"), high("x")))).withColumn("ty", F.explode(F.sequence(low("y"), high("y"))))
        spread = spread.join(homes, ["g", "tx", "ty"], "left_semi").join(asked, "id", "left")
        home = (tile(F.col("x")) == F.col("tx")) & (tile(F.col("y")) == F.col("ty"))
        inner = lambda c, t: F.least(F.col(c) - F.col(t) * F.col("side"), (F.col(t) + 1) * F.col("side") - F.col(c))
        far = F.when(F.col("whole"), F.lit(float("inf"))).otherwise(F.least(inner("x", "tx"), inner("y", "ty")) + margin)
        rows = spread.select("g", "tx", "ty", "id", "x", "y", "mark", F.coalesce(F.col("ask") & home, F.lit(False)).alias("ask"), far.alias("far"))
        key = ["g", "tx", "ty"]
        found = cut(rows.repartition(n, *key).groupBy(*key).applyInArrow(_tile(k, include_self, marked), OUT))
        out.append(found.where("rank >= 0"))
        asked = found.where("rank < 0").select("id").withColumn("ask", F.lit(True))
        if asked.isEmpty():
            break
    else:  # outliers: each asks all blocks of its frame
        block = told.select("g", "id", "x", "y", "mark", F.lit(False).alias("ask"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("b"))
        sent = told.join(asked, "id").select("g", "id", "x", "y", "mark", F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"))
        each = block.unionByName(sent).groupBy("g", "b").applyInArrow(_block(k, include_self), OUT)
        w = Window.partitionBy("id").orderBy("d2", "nb")
        last = each.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)
        if marked:
            hit = last.join(told.where("mark").select(F.col("id").alias("nb"), F.lit(True).alias("hit")), "nb", "left")
            last = hit.select("id", "nb", "rank", F.when(F.col("hit") & (F.col("d2") > 0), F.col("d2")).otherwise(F.lit(float("inf"))).alias("d2"))
        out.append(last)
    every = out[0]
    for f in out[1:]:
        every = every.unionByName(f)
    return every


def _block(k: int, include_self: bool):
    def run(t: pa.Table) -> pa.Table:
        ids, x, y = (t[c].to_numpy() for c in ("id", "x", "y"))
        ask = t["ask"].to_numpy(zero_copy_only=False)
        have, rows, out = np.flatnonzero(~ask), np.flatnonzero(ask), []
        have = have[np.argsort(ids[have])]
        for r in rows:
            d = (x[have] - x[r]) ** 2 + (y[have] - y[r]) ** 2
            if not include_self:
                d[ids[have] == ids[r]] = np.inf
            o = np.argsort(d, kind="stable")[:k]
            o = o[np.isfinite(d[o])]
            out.append((np.full(len(o), ids[r]), ids[have[o]], np.zeros(len(o), np.int32), d[o]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)]
        return pa.table(dict(zip(("id", "nb", "rank", "d2"), cols)))

    return run


#: Numbers in one block of vectors, and in one matrix of distances, of a search over blocks.
BLOCK_NUMBERS, MATRIX_NUMBERS = 4_000_000, 8_000_000


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def over_blocks(vectors: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    """``run(block of vectors, block of queries)`` for every block of either, within groups: vectors (g, id, v, ...), queries (g, qid, q, ...).

    The numbers of blocks follow from the numbers of rows and of dimensions, so that a task holds a bounded part of both.
    """
    dim = vectors.select(F.max(F.size("v"))).first()[0] or 1
    rows = max(1, BLOCK_NUMBERS // dim)
    n, m = (max(1, -(-df.count() // rows)) for df in (vectors, queries))
    n = max(n, min(parts(vectors.sparkSession), -(-vectors.count() // 256)))  # enough blocks for all cores
    deal = lambda df, key, own, k, other, j: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(k))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(j - 1).cast("long"))))
    left, right = deal(vectors, "id", "b", n, "c", m), deal(queries, "qid", "c", m, "b", n)
    key = ["g", "b", "c"]
    out = parts(vectors.sparkSession)
    return left.repartition(out, *key).groupBy(*key).cogroup(right.repartition(out, *key).groupBy(*key)).applyInArrow(run, schema)


def distance_rows(q: np.ndarray, v: np.ndarray):
    """(rows of q, their squared distances to v and the error bound of these), in slices that bound memory: one matrix product each."""
    vv = (v * v).sum(1)
    for s in range(0, len(q), step := max(1, MATRIX_NUMBERS // max(1, len(v)))):
        part = q[s : s + step]
        qq = (part * part).sum(1)
        yield slice(s, s + len(part)), np.maximum(qq[:, None] + vv[None] - 2 * (part @ v.T), 0), 1e-12 * (qq + vv.max(initial=0.0))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, *, group: str | None = None, skip_self: bool = False) -> DataFrame:
    """(qid, id, rank, distance): exact Euclidean neighbours of the stated queries (qid, q) among all vectors (id, v).

    Blocks of the vectors meet blocks of the queries (of the same ``group``, a bigint column of both, if one is named); each
    answers with its k best, which are merged per query. ``skip_self`` leaves out the vector whose id is the query's.
    """
    g = F.lit(0).cast("long") if group is None else F.col(group)
    v = vectors.select(g.alias("g"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).dropna()
    q = queries.select(g.alias("g"), F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).dropna()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, ids, y, qids = matrix(left["v"]), left["id"].to_numpy(), matrix(right["q"]), right["qid"].to_numpy()
            for s, d2, error in distance_rows(y, x):
                if skip_self:
                    d2[qids[s, None] == ids[None]] = np.inf
                worst = np.partition(d2, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1]
                i, j = np.nonzero((d2 <= (worst + error)[:, None]) & np.isfinite(d2))  # all that may be among the k nearest
                d = np.sqrt(((y[s][i] - x[j]) ** 2).sum(1))
                order = np.lexsort((ids[j], d.round(9), i))
                i, j, d = i[order], j[order], d[order]
                ok = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((qids[s][i[ok]], ids[j[ok]], d[ok]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("qid", "id", "d"), cols)))

    each = over_blocks(v, q, run, "qid long, id long, d double")
    w = Window.partitionBy("qid").orderBy(F.round("d", 9), "id")
    return each.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("qid", "id", "rank", F.col("d").alias("distance"))
