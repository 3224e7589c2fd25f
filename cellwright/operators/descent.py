"""An approximate graph of nearest neighbours by neighbour descent, in any number of dimensions.

Records are cut into blocks along two shifted Morton curves; inside a block each record starts with its neighbours on the
curve and takes over the nearest of its neighbours' neighbours, until few lists change. The lists of both curves are
merged, and rounds over the whole table go on where they differ or have changed - the neighbours of a record (reverse ones
sampled) are compared with each other - until few changes are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.runtime import cut, drop, parts, runs

#: Records in one block of a curve; numbers of a curve's key; share of the edges below which changes are few.
BLOCK, AXES, FEW = 16_384, 12, 0.001
EDGE = "u long, v long, d double, fresh boolean, block long"


def _matrix(column, dim):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def morton(x: np.ndarray, low: np.ndarray, high: np.ndarray, shift: float) -> np.ndarray:
    """Interleaved bits of the first numbers of each row, scaled to their group's box."""
    x, low, high = x[:, :AXES], low[:, :AXES], high[:, :AXES]
    bits = min(16, 60 // x.shape[1])
    span = np.where(high > low, high - low, 1.0)
    grid = (((x - low) / span + shift) / (1 + shift) * (2**bits - 1)).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for b in range(bits):
        for j in range(x.shape[1]):
            out |= ((grid[:, j] >> b) & 1) << (b * x.shape[1] + j)
    return out


def _curve(dim: int):
    def run(batches):
        for b in batches:
            vec, low, high = (_matrix(b[c], dim) for c in ("vec", "low", "high"))
            for n, shift in enumerate((0.0, 0.37)):
                yield pa.RecordBatch.from_arrays([b["g"], b["loc"], b["vec"], pa.array(np.full(len(vec), n, np.int32)), pa.array(morton(vec, low, high, shift))], ["g", "loc", "vec", "n", "z"])

    return run


def _take_best(rows, near, d, cand, x, width, radius):
    """Lists of ``rows`` improved by candidates (-1: none): (indices, distances), each candidate once, the nearest ``width``."""
    far = np.sqrt(((x[rows, None] - x[np.maximum(cand, 0)]) ** 2).sum(2))
    far[(cand < 0) | (cand == rows[:, None]) | (far > radius)] = np.inf
    every, dist = np.hstack([near[rows], cand]), np.hstack([d[rows], far])
    order = np.lexsort((dist, every), axis=1)
    every, dist = np.take_along_axis(every, order, 1), np.take_along_axis(dist, order, 1)
    dist[:, 1:][every[:, 1:] == every[:, :-1]] = np.inf
    best = np.argsort(dist, 1, kind="stable")[:, :width]
    every, dist = np.take_along_axis(every, best, 1), np.take_along_axis(dist, best, 1)
    every[np.isinf(dist)] = -1
    return every, dist


def descend(x: np.ndarray, g: np.ndarray, width: int, radius: float, seed: int = 0):
    """Neighbour descent inside one block, whose rows lie in the order of a curve: (indices or -1, distances), rising."""
    n, rng = len(x), np.random.default_rng(seed)
    lags = np.r_[-width:0, 1 : width + 1]
    cand = np.arange(n)[:, None] + lags
    cand[(cand < 0) | (cand >= n)] = -1
    cand[g[np.maximum(cand, 0)] != g[:, None]] = -1
    near, d = np.full((n, width), -1), np.full((n, width), np.inf)
    slices = lambda rows, m: np.array_split(rows, max(1, len(rows) * m * x.shape[1] // 8_000_000))
    for rows in slices(np.arange(n), len(lags)):
        near[rows], d[rows] = _take_best(rows, near, d, cand[rows], x, width, radius)
    moved = np.ones(n, bool)
    while True:
        src, dst = np.nonzero(near >= 0)[0], near[near >= 0]
        mix = rng.permutation(len(src))
        src, dst = src[mix], dst[mix]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        back = np.full((n, width), -1)
        back[dst[rank < width], rank[rank < width]] = src[rank < width]
        known = np.hstack([near, back])
        rows = np.flatnonzero(((known >= 0) & moved[np.maximum(known, 0)]).any(1) | moved)
        changed, hits = np.zeros(n, bool), 0
        old = near.copy()
        for part in slices(rows, width * (width + 1)):
            onward = np.where(near[part][:, :, None] >= 0, old[np.maximum(near[part], 0)], -1).reshape(len(part), -1)
            got, dist = _take_best(part, near, d, np.hstack([back[part], onward]), x, width, radius)
            new = ((got[:, :, None] != old[part][:, None]).all(2) & (got >= 0)).sum(1)
            near[part], d[part] = got, dist
            changed[part], hits = new > 0, hits + int(new.sum())
        moved = changed
        if hits <= FEW * n * width:
            return near, d


def _blocks(dim: int, width: int, radius: float):
    """Edges that descent finds in blocks of the batch stream, which comes in the order of curve, group and key."""

    def edges(t: pa.Table, name: int):
        n, g, loc = (t[c].to_numpy() for c in ("n", "g", "loc"))
        near, d = descend(_matrix(t["vec"], dim), g ^ n, width, radius)
        r, c = np.nonzero(near >= 0)
        block = np.where(n[r] == 0, name, -1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (loc[r], loc[near[r, c]], d[r, c], np.ones(len(r), bool), block)], ["u", "v", "d", "fresh", "block"])

    def run(batches):
        from pyspark import TaskContext

        held, name = [], TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= 2 * BLOCK:
                t = pa.Table.from_batches(held)
                yield edges(t.slice(0, BLOCK), name)
                held, name = t.slice(BLOCK).to_batches(), name + 1
        if held:
            yield edges(pa.Table.from_batches(held), name)

    return run


def _best(k: int, first: bool):
    """The k nearest of each u. Edges are fresh that are new to u: at ``first`` those which only one curve found, then the found ones."""

    def run(batches):
        for t in runs(batches, "u"):
            u, v, d, fresh, block = (t[c].to_numpy(zero_copy_only=False) for c in ("u", "v", "d", "fresh", "block"))
            order = np.lexsort((fresh, v, d, u))
            u, v, d, fresh, block = (x[order] for x in (u, v, d, fresh, block))
            head = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
            starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            name = np.repeat(np.maximum.reduceat(block, starts), np.diff(np.r_[starts, len(u)]))
            if first:
                fresh = np.concatenate((head[1:], [True]))  # no second row of the pair follows
            u, v, d, fresh, name = (x[head] for x in (u, v, d, fresh, name))
            starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)]))
            ok = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (u, v, d, fresh, name)], ["u", "v", "d", "fresh", "block"])

    return run


def _compare(dim: int, most: int, radius: float):
    """Neighbours m of c compared with each other where one is fresh: pairs nearer than the worst of their lists so far."""

    def run(batches):
        for t in runs(batches, "c"):
            c, m, fresh, worst, vec = t["c"].to_numpy(), t["m"].to_numpy(), t["fresh"].to_numpy(zero_copy_only=False), t["worst"].to_numpy(), _matrix(t["vec"], dim)
            draw = (m.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            order = np.lexsort((draw, ~fresh, c))  # a hub is compared by a sample of its reverse neighbours
            rank = np.arange(len(c)) - np.searchsorted(c[order], c[order])
            order = order[rank < most]
            c, m, fresh, worst, vec = c[order], m[order], fresh[order], worst[order], vec[order]
            lag, i = 1, np.arange(len(c))
            while True:
                i = i[i + lag < len(c)]
                i = i[c[i] == c[i + lag]]
                if not len(i):
                    break
                j = i + lag
                e = np.sqrt(((vec[i] - vec[j]) ** 2).sum(1))
                ok = (fresh[i] | fresh[j]) & (e <= radius) & (m[i] != m[j])
                for a, b in ((i, j), (j, i)):
                    hit = ok & (e < worst[a])
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(m[a[hit]]), pa.array(m[b[hit]]), pa.array(e[hit])], ["u", "v", "d"])
                lag += 1

    return run


def neighbour_descent(places: DataFrame, dim: int, k: int, radius: float = float("inf"), width: int | None = None) -> DataFrame:
    """(u, v, d, fresh, block): about the k nearest of each place of its group. ``places``: g, loc, vec, low, high.

    ``width``: length of the lists while descending, longer than k in many dimensions; ``block``: a part of u's group.
    """
    width = width or max(k, min(48, 2 * dim))
    n = parts(places.sparkSession, 4)
    curves = places.mapInArrow(_curve(dim), "g long, loc long, vec array<double>, n int, z long")
    line = curves.repartitionByRange(n, "n", "g", "z").sortWithinPartitions("n", "g", "z", "loc")
    best = lambda e, first: cut(e.repartition(n, "u").sortWithinPartitions("u").mapInArrow(_best(width, first), EDGE))
    edges = best(line.mapInArrow(_blocks(dim, width, radius), EDGE), True)
    while True:
        size = edges.agg(F.count("*"), F.count_if("fresh")).first()
        if not size[0] or size[1] <= FEW * size[0]:
            break
        worst = edges.groupBy(F.col("u").alias("m")).agg(F.when(F.count("*") >= width, F.max("d")).alias("worst"))
        told = places.select(F.col("loc").alias("m"), "vec").join(worst, "m", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh"))
        live = both.where("fresh").select("c").distinct()
        sent = both.join(live, "c", "left_semi").join(told, "m").select("c", "m", "fresh", "worst", "vec")
        found = sent.repartition(n, "c").sortWithinPartitions("c").mapInArrow(_compare(dim, 2 * width, radius), "u long, v long, d double")
        known = edges.withColumn("fresh", F.lit(False))
        better = best(known.unionByName(found.distinct().select("u", "v", "d", F.lit(True).alias("fresh"), F.lit(-1).cast("long").alias("block"))), False)
        drop(edges)
        edges = better
    if width == k:
        return edges
    final = cut(edges.repartition(n, "u").sortWithinPartitions("u").mapInArrow(_best(k, False), EDGE))
    drop(edges)
    return final
