"""Layout of a graph of nearest neighbours in the plane: uniform manifold approximation and projection (UMAP).

Distances become memberships in a fuzzy set around each point, the union of these sets is a graph, its leading eigenvectors are the
start, and the points follow attraction along sampled edges and repulsion from random points. A task holds the edges of a block
of points and moves these alone; after some epochs the blocks exchange places. All places, eight bytes a point, come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.runtime import cut, drop

#: Points that one task moves; epochs between two exchanges of places; random points that push for each edge that pulls; edges at once.
BLOCK, EPOCHS, PUSHES, TOGETHER = 32_768, 20, 5, 8
#: Vectors of the subspace, degree of its filter, the residual that will do for a start, and filters at most.
WIDTH, DEGREE, RESIDUAL, FILTERS = 6, 12, 0.01, 20


def falling_curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b) nearest to a curve that is 1 up to ``min_dist`` and falls exponentially from there (least squares)."""
    x = np.linspace(0, 3 * spread, 300)[1:]  # both are 1 at 0
    y, p, damp = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread)), np.array([0.0, 1.0]), 1e-3  # log a, b
    cost = lambda q: (1 / (1 + np.exp(q[0]) * x ** (2 * q[1])) - y)
    for _ in range(200):
        off, g = cost(p), np.exp(p[0]) * x ** (2 * p[1])
        j = np.stack([-g / (1 + g) ** 2, -g * 2 * np.log(x) / (1 + g) ** 2], 1)
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h)), -j.T @ off)
        better = (cost(p + step) ** 2).sum() < (off**2).sum()
        p, damp = (p + step, damp / 5) if better else (p, damp * 5)
        if better and np.abs(step).max() < 1e-10:
            break
    return float(np.exp(p[0])), float(p[1])


def widths(d: np.ndarray, k: int, local: int, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of rows of rising distances to the others (infinite: none): memberships exp(-(d - rho) / sigma) sum to log2 k."""
    there = np.isfinite(d)
    rho = np.where(there & (d > 0), d, np.inf).min(1, initial=np.inf) if local else np.full(len(d), np.inf)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    off = np.maximum(np.where(there, d, np.inf) - rho[:, None], 0.0)
    for _ in range(64):
        much = np.exp(-off / sigma[:, None]).sum(1) > np.log2(k)
        low, high = np.where(much, low, sigma), np.where(much, sigma, high)
        sigma = np.where(np.isinf(high), 2 * sigma, (low + np.where(np.isinf(high), 0.0, high)) / 2)
    own = np.where(there, d, 0.0).sum(1) / np.maximum(there.sum(1) + 1, 1)  # each is its own neighbour, at 0
    return rho, np.maximum(sigma, 1e-3 * np.where(rho > 0, own, mean))


def _memberships(k: int, local: int, mean: float):
    def run(batches):
        for b in batches:
            x = b.column("x")
            size, v, d = np.diff(x.offsets.to_numpy()), x.flatten().field("v").to_numpy(), x.flatten().field("d").to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            wide = np.full((len(size), max(1, size.max(initial=1))), np.inf)
            wide[row, np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)] = d
            rho, sigma = widths(wide, k, local, mean)
            w = np.exp(-np.maximum(d - rho[row], 0.0) / np.maximum(sigma[row], 1e-300))
            yield pa.RecordBatch.from_arrays([pa.array(b.column("u").to_numpy()[row]), pa.array(v), pa.array(w)], ["u", "v", "w"])

    return run


def memberships(near: DataFrame, k: int, local: int, mean: float) -> DataFrame:
    """(u, v, w) of the k - 1 nearest others (u, v, d) of every u; the nearest ``local`` (0 or 1) distance counts as none."""
    lists = near.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("x"))  # k rows
    return lists.mapInArrow(_memberships(k, local, mean), "u long, v long, w double")


def fuzzy_union(w: DataFrame) -> DataFrame:
    """(u, v, w) in both directions: a + b - ab of the memberships of each in the other's set."""
    both = w.unionByName(w.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v")
    s = both.agg(F.max("w").alias("a"), F.when(F.count("*") > 1, F.min("w")).otherwise(0.0).alias("b"))
    return s.select("u", "v", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def _pack(batches):
    """One row per partition: its block of edges, sorted by u."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        raw = lambda c, kind: pa.array([t[c].to_numpy().astype(kind).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([raw("u", np.int32), raw("v", np.int32), raw("w", np.float32)], ["u", "v", "w"])


def blocks_of(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, w) as one row of packed arrays per block of consecutive u."""
    count = max(min(edges.sparkSession.sparkContext.defaultParallelism, -(-n // 256)), -(-n // BLOCK), 1)
    at = F.floor(F.col("u") * count / n).cast("int")
    rows = edges.withColumn("b", at).repartitionById(count, "b").sortWithinPartitions("u", "v").select("u", "v", "w")
    return cut(rows.mapInArrow(_pack, "u binary, v binary, w binary"))


def _over_blocks(blocks: DataFrame, told, work) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``work`` (shared, u, v, w) yields for each block, as (places, rows of numbers)."""
    shared = blocks.sparkSession.sparkContext.broadcast(told)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                u, v, w = (np.frombuffer(b.column(c)[i].as_py(), kind) for c, kind in (("u", np.int32), ("v", np.int32), ("w", np.float32)))
                at, rows = work(shared.value, u, v, w)
                yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([rows.astype(np.float32).tobytes()])], ["at", "rows"])

    t = blocks.mapInArrow(run, "at binary, rows binary").toArrow()
    shared.destroy()
    out = []
    for at, rows in zip(t["at"].to_pylist(), t["rows"].to_pylist()):
        at = np.frombuffer(at, np.int32)
        out.append((at, np.frombuffer(rows, np.float32).reshape(len(at), -1)))
    return out


def _gather(blocks: DataFrame, told, work, into: np.ndarray) -> np.ndarray:
    for at, rows in _over_blocks(blocks, told, work):
        into[at] = rows
    return into


def _sums(x, u, v, w):
    first = np.flatnonzero(np.diff(u, prepend=-1))
    return u[first], np.add.reduceat(x[v] * w[:, None], first)


def spectral_start(blocks: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """(n, 2): the two leading eigenvectors of the normalised graph after the trivial one, at most 10 off zero, slightly moved.

    A subspace is filtered by Chebyshev polynomials, which damp what lies below its smallest value.
    """
    rng = np.random.default_rng(seed)
    degree = _gather(blocks, np.ones((n, 1), np.float32), _sums, np.zeros((n, 1), np.float32))
    root = np.sqrt(np.maximum(degree, 1e-12)).astype(np.float64)
    trivial = root / np.linalg.norm(root)
    free = lambda x: x - trivial @ (trivial.T @ x)
    times = lambda x: free(_gather(blocks, (x / root).astype(np.float32), _sums, np.zeros(x.shape)) / root)
    width = min(WIDTH, max(n - 1, 1))
    x = np.linalg.qr(free(rng.normal(size=(n, width))))[0]
    for _ in range(FILTERS):
        y = times(x)
        value, turn = np.linalg.eigh(x.T @ y)
        value, turn = value[::-1], turn[:, ::-1]
        x, y = x @ turn, y @ turn
        if (np.linalg.norm(y - x * value, axis=0)[:2] <= RESIDUAL).all() or width < WIDTH:
            break
        middle, half = (value[-1] - 1) / 2, max((value[-1] + 1) / 2, 1e-3)
        before, now = x, (y - middle * x) / half
        for _ in range(DEGREE - 1):
            before, now = now, 2 / half * (times(now) - middle * now) - before
            norm = np.maximum(np.linalg.norm(now, axis=0), 1e-300)
            before, now = before / norm, now / norm
        x = np.linalg.qr(free(now))[0]
    x = np.hstack([x[:, :2], np.zeros((n, max(0, 2 - width)))])
    return (x * (10 / max(np.abs(x).max(), 1e-300)) + rng.normal(scale=1e-4, size=x.shape)).astype(np.float32)


def _moves(begin: int, end: int, epochs: int, curve: tuple[float, float], rate: float, mutual: bool, seed: int):
    """Work for a block: its points after the epochs from ``begin`` to ``end``. ``mutual``: an edge moves both of its ends, among
    the others that are moved; else the places of all others are fixed. An edge of weight w (1: the largest) is sampled w times an epoch.
    A point's edges act ``TOGETHER`` at most, then from where it went: one that is near to many would be thrown out by their sum.
    """
    a, b, near, tiny = (np.float32(c) for c in (*curve, 0.001, 1e-30))
    pull = np.float32(2 if mutual else 1)  # once as the one end and once as the other

    def work(told, u, v, w):
        places, fixed = told
        x, y = (np.ascontiguousarray(places[:, c]) for c in (0, 1))
        fx, fy = (x, y) if mutual else (np.ascontiguousarray(fixed[:, c]) for c in (0, 1))
        first = np.flatnonzero(np.diff(u, prepend=-1))
        own = u[first]
        row = np.repeat(np.arange(len(own)), np.diff(np.r_[first, len(u)]))
        rng = np.random.default_rng([seed, begin, int(u[0])])
        share = w.astype(np.float64)
        due = begin * share % 1.0
        for t in range(begin, end):
            due += share
            e = np.flatnonzero(due >= 1 - 1e-9)
            due[e] -= 1
            start = np.flatnonzero(np.diff(row[e], prepend=-1))
            turn = (np.arange(len(e)) - np.repeat(start, np.diff(np.r_[start, len(e)]))) // TOGETHER
            e = e[np.argsort(turn, kind="stable")]
            alpha = np.float32(rate * (1 - t / epochs))
            for part in np.split(e, np.cumsum(np.bincount(turn))[:-1]):
                if not len(part):
                    continue
                h, o = u[part], v[part]
                px, py = x[h], y[h]
                dx, dy = px - fx[o], py - fy[o]
                d = dx * dx + dy * dy
                g = d**b
                g = np.where(d > 0, -2 * a * b * g / (np.maximum(d, tiny) * (1 + a * g)), 0)
                mx, my = pull * np.clip(g * dx, -4, 4), pull * np.clip(g * dy, -4, 4)
                o = rng.integers(0, len(fx), (PUSHES, len(part)), np.int32)
                dx, dy = px - fx[o], py - fy[o]
                d = dx * dx + dy * dy
                g = 2 * b / ((near + d) * (1 + a * d**b))
                mx += np.clip(g * dx, -4, 4).sum(0)
                my += np.clip(g * dy, -4, 4).sum(0)
                start = np.flatnonzero(np.diff(h, prepend=-1))
                x[h[start]] += alpha * np.add.reduceat(mx, start)
                y[h[start]] += alpha * np.add.reduceat(my, start)
        return own, np.stack([x[own], y[own]], 1)

    return work


def numbered(labels: DataFrame) -> DataFrame:
    """(id, at): numbers without gaps, in the order of the labels, so that most neighbours fall into one block."""
    rows = cut(labels.repartitionByRange("label", "id").sortWithinPartitions("label", "id").select("id", F.monotonically_increasing_id().alias("m")))
    part, before, offsets = F.shiftright("m", 33), 0, []
    for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r.p, before))
        before += r.n
    told = F.broadcast(rows.sparkSession.createDataFrame(offsets, "p long, before long"))  # one row per partition
    return cut(rows.withColumn("p", part).join(told, "p").select("id", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at")))


def plane(labels: DataFrame, near: DataFrame, k: int, **how) -> DataFrame:
    """(id, umap_1, umap_2): :func:`plane_layout` of the ids (id, label) with neighbours (u, v, d)."""
    at, s = numbered(labels), labels.sparkSession
    of = lambda c: at.select(F.col("id").alias(c), F.col("at").alias(f"at_{c}"))
    edges = cut(near.join(of("u"), "u").join(of("v"), "v").select(F.col("at_u").alias("u"), F.col("at_v").alias("v"), "d"))
    n = at.count()
    xy = plane_layout(edges, n, k, **how)
    told = s.sparkContext.broadcast(xy)

    def run(batches):
        for b in batches:
            p = told.value[b.column("at").to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(p[:, c].astype(float)) for c in (0, 1))], ["id", "umap_1", "umap_2"])

    return at.mapInArrow(run, "id long, umap_1 double, umap_2 double")


def plane_layout(near: DataFrame, n: int, k: int, min_dist: float = 0.1, epochs: int = 1000, seed: int = 0) -> np.ndarray:
    """(n, 2): places of the points 0 to n - 1 by their k - 1 nearest others (u, v, d), fitted and then transformed as new points.

    The transform starts at the weighted mean of a point's neighbours and itself, and moves it for a third of the epochs
    among the fitted points, which stay.
    """
    if not n:
        return np.zeros((0, 2), np.float32)
    mean = float(near.agg(F.sum("d")).first()[0] or 0.0) / max(1, n * k)
    curve = falling_curve(min_dist)

    def packed(w: DataFrame, rounds: int) -> DataFrame:
        w = cut(w)
        top = w.agg(F.max("w")).first()[0] or 1.0
        out = blocks_of(w.where(F.col("w") >= top / rounds).withColumn("w", F.col("w") / top), n)
        drop(w)
        return out

    blocks = packed(fuzzy_union(memberships(near, k, 1, mean)), epochs)
    at = spectral_start(blocks, n, seed)
    for begin in range(0, epochs, EPOCHS):
        at = _gather(blocks, (at, None), _moves(begin, min(epochs, begin + EPOCHS), epochs, curve, 1.0, True, seed), at.copy())
    drop(blocks)
    self_too = near.sparkSession.range(n).select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))
    blocks = packed(memberships(near, k, 0, mean).unionByName(self_too), max(1, epochs // 3))
    mid = lambda x, u, v, w: (lambda own, s: (own, s[:, :2] / s[:, 2:]))(*_sums(x, u, v, w))
    start = _gather(blocks, np.hstack([at, np.ones((n, 1), np.float32)]), mid, at.copy())
    out = _gather(blocks, (start, at), _moves(0, epochs // 3, max(1, epochs // 3), curve, 0.25, False, seed + 1), start.copy())
    drop(blocks)
    return out
