"""The k most similar vectors of every vector, within groups, by cross-polytope hashing.

Method: vectors become unit vectors (cosine: scaled; Euclidean: lifted from R^d to the sphere S^d by inverse
stereographic projection, so that near points stay near). A hash function applies a fast Hadamard pseudo-rotation (three
rounds of random signs and a Hadamard transform) and takes the nearest signed axis; a table concatenates as many functions
as its group needs. Besides its own bucket a vector probes those reached by flipping its least certain functions to their
second axis. All candidates are reranked by their exact distance.

The number of functions is fitted per group on a bounded sample (``SAMPLE`` vectors) so that the sparser half of the
vectors meet about ``target`` others in their bucket; every vector is indexed. A bucket of more than ``HOT * target`` vectors becomes
a group of its own: it is lifted by its own box, which brings its inner distances to the scale of the sphere, gets its own
number of functions and is hashed again, until no bucket is too large. What hashing can't tell apart any more is met in
blocks of bounded size, as are the asked vectors of the last step: a vector that met fewer than k others (and fewer than
its group has) asks again in tables of half as many functions, down to none, where its whole group answers in blocks.

Equal vectors are indexed once: a place keeps its ``k + 1`` smallest ids, which is all that any answer can hold, so copies cost
no pairs of copies.

Defined results: a null id or group part, a null or unusable vector (null, NaN, infinite or, for ``cosine``, all-zero
element; another length than ``dim``) takes no part; ids that come twice count once (their first place in order); ties in
distance go to the smaller id; groups of fewer than k + 1 vectors give all their pairs; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwright.runtime import cut, drop, parts, runs

#: Vectors that the functions of a group are fitted on; functions of one level at most; axes at least; a full bucket, in targets.
SAMPLE, FUNCTIONS, MIN_AXES, HOT = 4000, 60, 32, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hadamard(v: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows (length a power of two)."""
    n, d, h = len(v), v.shape[1], 1
    while h < d:
        v = v.reshape(n, -1, 2, h)
        v = np.concatenate([v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return v / v.dtype.type(np.sqrt(d))


def _signs(dim: int, axes: int, table: int, function: int, seed: int):
    """Signs of the three rounds, the axes that repeat another one on inputs of ``dim`` numbers, and the map as a matrix."""
    signs = np.random.default_rng([seed, table, function]).choice([-1.0, 1.0], (3, axes))
    basis = np.eye(axes)[:dim]
    for s in signs:
        basis = hadamard(basis * s)
    rows = basis.T
    lead = rows[np.arange(axes), (np.abs(rows) > 1e-12).argmax(1)]
    _, first = np.unique((rows * np.where(lead < 0, -1, 1)[:, None]).round(9), axis=0, return_index=True)
    return signs, np.setdiff1d(np.arange(axes), first), rows


def lift(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Inverse stereographic projection of the box low..high (one, or one per row) into a half of the sphere."""
    half = np.linalg.norm(high - low, axis=-1, keepdims=True) / 2
    u = (vectors - (low + high) / 2) / np.where(half > 0, half, 1.0)
    q = (u * u).sum(1, keepdims=True)
    return np.hstack([2 * u, q - 1]) / (1 + q)


def signed_axes(units: np.ndarray, functions: int, table: int, seed: int):
    """Nearest and second nearest signed axis of each row under each function, and how much nearer the first is.

    The transform is applied as it stands, or, for vectors much shorter than ``axes``, as the matrix that it makes of them.
    """
    dim = units.shape[1]
    axes = max(MIN_AXES, 1 << (dim - 1).bit_length())
    padded = np.zeros((len(units), axes if 4 * dim > axes else 0), np.float32)
    padded[:, :dim] = units[:, : padded.shape[1]]
    units = units.astype(np.float32)
    first, second, margin = (np.empty((len(units), functions), t) for t in (np.int16, np.int16, np.float32))
    row = np.arange(len(units))
    for f in range(functions):
        signs, same, composed = _signs(dim, axes, table, f, seed)
        if padded.shape[1]:
            v = padded
            for s in signs.astype(np.float32):
                v = hadamard(v * s)
        else:
            v = units @ composed.T.astype(np.float32)
        size = np.abs(v)
        size[:, same] = -1
        a = size.argmax(1)
        top = size[row, a].copy()
        size[row, a] = -1
        b = size.argmax(1)
        first[:, f], second[:, f] = 2 * a + (v[row, a] < 0), 2 * b + (v[row, b] < 0)
        margin[:, f] = top - size[row, b]
    return first, second, margin


def _key(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    z = start.astype(np.uint64)
    for j in range(codes.shape[1]):
        z = (z ^ (codes[:, j].astype(np.uint64) + np.uint64(1))) * _MIX
        z ^= z >> np.uint64(29)
    return z.view(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(vectors, low, high, lifted: bool):
    return lift(vectors, low, high) if lifted else vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _fit(dim: int, lifted: bool, target: int, level: int, seed: int):
    """The number of functions of one group from its sample."""

    def run(sample: pa.Table) -> pa.Table:
        n, vecs = sample["n"][0].as_py(), _matrix(sample["vec"], dim)
        units = _units(vecs, np.array(sample["low"][0].as_py()), np.array(sample["high"][0].as_py()), lifted)
        codes, key, need = None, np.zeros(len(units), np.uint64), 0
        while need < FUNCTIONS:
            _, at, sizes = np.unique(key, return_inverse=True, return_counts=True)
            others = np.sort(sizes[at] - 1)[: (len(at) + 1) // 2]  # of the sparser half
            if others.mean() * n <= target * max(1, len(at) - 1):
                break
            if codes is None or need == codes.shape[1]:  # a few functions at a time
                codes = signed_axes(units, min(FUNCTIONS, 4 + 2 * need), level, seed)[0]
            key = _key(codes[:, need : need + 1], key).view(np.uint64)
            need += 1
        return pa.table({"b": sample["b"][:1], "functions": pa.array([need], pa.int32())})

    return run


HASHED = "key long, g long, loc long, vec array<double>, home boolean, asks boolean"


def _hash(dim: int, lifted: bool, level: int, tables: int, probes: int, seed: int):
    """The buckets of every row (b, g, loc, vec, low, high, functions, home, asks): of home rows also those they probe."""

    def run(batches):
        for batch in batches:
            bucket, fn, home = batch["b"].to_numpy(), batch["functions"].to_numpy(), batch["home"].to_numpy(zero_copy_only=False)
            asks = batch["asks"].to_numpy(zero_copy_only=False)
            vecs, low, high = (_matrix(batch[c], dim) for c in ("vec", "low", "high"))
            for need in np.unique(fn):
                same = np.flatnonzero(fn == need)
                units = _units(vecs[same], low[same], high[same], lifted)
                for t in range(tables):
                    a, second, margin = signed_axes(units, int(need), 100 * level + t, seed)
                    start = bucket[same].view(np.uint64) ^ np.uint64(100 * level + t + 1)
                    flips = np.argsort(margin, 1)[:, :probes]
                    turns = [[]] + [[j] for j in range(flips.shape[1])] + ([[0, 1]] if flips.shape[1] > 1 else [])
                    for turn in turns:
                        rows = np.flatnonzero(asks[same] & home[same]) if turn else np.arange(len(same))
                        codes = a[rows]
                        for j in turn:
                            f = flips[rows, j]
                            codes[np.arange(len(rows)), f] = second[rows, f]
                        at = pa.array(same[rows])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "key": _key(codes, start[rows]), "g": batch["g"].take(at), "loc": batch["loc"].take(at), "vec": batch["vec"].take(at),
                                "home": home[same[rows]] & (not turn), "asks": asks[same[rows]],
                            }
                        )

    return run


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
        return 1 - a @ b.T
    if a.shape[1] <= 4:  # exact differences; few enough to add up one by one
        return sum((a[:, j, None] - b[None, :, j]) ** 2 for j in range(a.shape[1])) ** 0.5
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def nearest(d: np.ndarray, ids: np.ndarray, k: int):
    """Columns of the k smallest of each row (ties: smaller id), -1 where there are fewer; ids ascending."""
    m = d.shape[1]
    if m <= k:
        order = np.argsort(d, 1, kind="stable")
        order = np.pad(order, ((0, 0), (0, k - m)), constant_values=-1)
    else:
        order = np.argpartition(d, k - 1, 1)[:, :k]
        worst = np.take_along_axis(d, order, 1).max(1)
        tied = np.flatnonzero((d <= worst[:, None]).sum(1) > k)
        if len(tied):
            order[tied] = np.argsort(d[tied], 1, kind="stable")[:, :k]
    picked = np.where(order < 0, np.inf, np.take_along_axis(d, np.maximum(order, 0), 1))
    order[~np.isfinite(picked)] = -1
    return order, picked


def _rerank(dim: int, metric: str, k: int, cells: int = 2_000_000):
    def run(batches):
        for table in runs(batches, "key"):
            key, g, loc = (table[c].to_numpy() for c in ("key", "g", "loc"))
            vec, home, asks = _matrix(table["vec"], dim), table["home"].to_numpy(zero_copy_only=False), table["asks"].to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            homes = np.add.reduceat(home.astype(np.int64), bounds[:-1])
            out: list[tuple] = []
            for i in np.flatnonzero((homes > 0) & (np.diff(bounds) > 1)):
                h, who = (bounds[i] + np.flatnonzero(x[bounds[i] : bounds[i + 1]]) for x in (home, asks))
                h = h[np.argsort(loc[h])]
                step = max(1, cells // len(h))
                for first in range(0, len(who), step):
                    q = who[first : first + step]
                    d = distances(vec[q], vec[h], metric)
                    d[(loc[q, None] == loc[None, h]) | (g[q, None] != g[None, h])] = np.inf
                    order, picked = nearest(d, loc[h], k)
                    r, c = np.nonzero(order >= 0)
                    out.append((loc[q][r], loc[h][order[r, c]], picked[r, c]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "nb", "d"])

    return run


def _merge(k: int):
    def run(batches):
        for table in runs(batches, "q"):
            q, nb, d = (table[c].to_numpy() for c in ("q", "nb", "d"))
            order = np.lexsort((nb, d, q))
            q, nb, d = q[order], nb[order], d[order]
            keep = np.concatenate(([True], (q[1:] != q[:-1]) | (nb[1:] != nb[:-1])))  # equal pairs have equal distances
            q, nb, d = q[keep], nb[keep], d[keep]
            starts = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1))
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)]))))
            ok = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (q, nb, d)], ["q", "nb", "d"])

    return run


def _boxes(rows: DataFrame, dim: int) -> DataFrame:
    """(b, n, low, high): size and box of every group of (b, vec)."""
    v = F.col("vec")
    return rows.groupBy("b").agg(F.count("*").alias("n"), *(F.array(*(f(v[i]) for i in range(dim))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))))


def _hashed(rows: DataFrame, groups: DataFrame, dim: int, lifted: bool, level: int, tables: int, probes: int, target: int, seed: int) -> DataFrame:
    """The buckets of ``rows`` (b, g, loc, vec, home, asks), whose groups are fitted on samples first unless they say their functions."""
    if "functions" not in groups.columns:
        some = F.pmod(F.xxhash64("loc", F.lit(seed + level)), F.lit(1 << 30)) <= (1 << 30) * F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("n"))
        sample = rows.where("home").select("b", "loc", "vec").join(groups, "b").where(some).select("b", "n", "low", "high", "vec")
        fitted = sample.groupBy("b").applyInArrow(_fit(dim, lifted, target, 100 * level, seed), "b long, functions int")
        groups = groups.join(fitted, "b", "left").withColumn("functions", F.coalesce("functions", F.lit(0)))
    told = rows.join(groups.select("b", "low", "high", "functions"), "b").select("b", "g", "loc", "vec", "low", "high", "functions", "home", "asks")
    return told.repartition(parts(rows.sparkSession, 4), "loc").mapInArrow(_hash(dim, lifted, level, tables, probes, seed), HASHED)


def _met(keyed: DataFrame, full: DataFrame, most: int, dim: int, metric: str, k: int) -> DataFrame:
    """(q, nb, d): the k nearest of each asking row among the home rows of its bucket.

    ``full`` (key, n) lists the buckets with more than ``most`` home rows: these are dealt to blocks, and who asks goes to all of them.
    """
    n = F.col("blocks")
    dealt = keyed.join(full.select("key", F.ceil(F.col("n") / most).alias("blocks")), "key", "left").withColumn("own", F.when(n.isNull(), 0).otherwise(F.pmod(F.xxhash64("loc"), n)))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("asks") & n.isNotNull(), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array("own"))))
    at = F.when(n.isNull(), F.col("key")).otherwise(F.xxhash64("key", "block"))
    dealt = dealt.select(at.alias("key"), "g", "loc", "vec", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"), "asks")
    return dealt.repartition(parts(keyed.sparkSession, 4), "key").sortWithinPartitions("key").mapInArrow(_rerank(dim, metric, k), "q long, nb long, d double")


def _best(near: DataFrame, k: int) -> DataFrame:
    return near.repartition(parts(near.sparkSession, 4), "q").sortWithinPartitions("q").mapInArrow(_merge(k), "q long, nb long, d double")


def similar_vectors(
    df: DataFrame, id_col: str, vector: str, group: list[str], dim: int, k: int = 5, *, metric: str = "euclidean",
    tables: int = 3, probes: int = 4, target: int = 100, seed: int = 7,
) -> DataFrame:
    """(id, neighbour, distance): the k nearest of each id within its group; see the module's text."""
    v, most = F.col("vec"), HOT * target
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c in group), F.lit(seed)).alias("g"),
                     F.col(f"`{vector}`").cast("array<double>").alias("vec"), *(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group)))
    rows = rows.dropna(subset=["id", "vec", *(f"_g{i}" for i in range(len(group)))]).where(F.size(v) == dim)
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.where(F.exists(v, lambda x: x != 0)).withColumn("vec", F.transform(v, lambda x: x / norm))
    rows = rows.groupBy("id").agg(F.min(F.struct("g", "vec")).alias("r")).select("id", "r.g", "r.vec")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g", "vec").orderBy("id"))).where(F.col("rank") <= k + 1)
    places = cut(ranked.groupBy("g", "vec").agg(F.min("id").alias("loc"), F.sort_array(F.collect_list("id")).alias("ids")))
    known = places.select(F.col("g").alias("b"), "g", "loc", "vec", F.lit(True).alias("home"), F.lit(True).alias("asks"))
    lifted = metric == "euclidean"
    groups = cut(_boxes(known.select("b", "vec"), dim))

    keyed, level, settled, before = cut(_hashed(known, groups, dim, lifted, 0, tables, probes, target, seed)), 0, [], None
    while True:
        full = cut(keyed.where("home").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most))
        now = full.agg(F.count("*"), F.sum("n")).first()
        if not now[0] or now == before:  # nothing too full, or nothing left that hashing can tell apart
            break
        settled.append(keyed.join(full, "key", "left_anti").select(*keyed.columns))
        inside = cut(keyed.join(full.select("key"), "key").select(F.col("key").alias("b"), "g", "loc", "vec", "home", "asks"))
        before, level = now, level + 1
        keyed = cut(_hashed(inside, _boxes(inside.where("home").select("b", "vec"), dim), dim, True, level, 2, probes, target, seed))
    near = _met(keyed, full, most, dim, metric, k)
    none = full.where("false")
    for cold in settled:
        near = near.unionByName(_met(cold, none, most, dim, metric, k))
    near = cut(_best(near, k))

    wide = groups.withColumn("functions", F.lit(FUNCTIONS))
    while True:  # who met too few asks again, in tables of half as many functions
        short = near.groupBy(F.col("q").alias("loc")).agg(F.count("*").alias("met"))
        asked = known.join(groups.select("b", "n"), "b").join(short, "loc", "left").where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1))
        asked = cut(asked.select("b", "loc"))
        if asked.isEmpty():
            break
        wide = cut(wide.join(asked.select("b").distinct(), "b", "left_semi").withColumn("functions", F.floor(F.col("functions") / 2).cast("int")))
        some = known.drop("asks").join(asked.select("loc", F.lit(True).alias("asks")), "loc", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        again = cut(_hashed(some, wide, dim, lifted, 0, tables, 0, target, seed))
        again = again.join(again.where("asks").select("key").distinct(), "key", "left_semi")
        counted = again.where("home").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
        more = cut(_best(near.unionByName(_met(again, counted, most, dim, metric, k)), k))
        drop(near)
        near = more

    shared = cut(places.where(F.size("ids") > 1).select("loc", "ids"))
    if shared.isEmpty():
        return near.select(F.col("q").alias("id"), F.col("nb").alias("neighbour"), F.col("d").alias("distance"))
    other = near.join(shared.withColumnRenamed("loc", "nb"), "nb", "left").select("q", F.explode(F.coalesce("ids", F.array("nb"))).alias("nb"), "d")
    own = shared.select(F.col("loc").alias("q"), F.explode("ids").alias("nb"), F.lit(0.0).alias("d"))
    every = other.unionByName(own).join(shared.withColumnRenamed("loc", "q"), "q", "left")
    every = _best(every.select(F.explode(F.coalesce("ids", F.array("q"))).alias("q"), "nb", "d").where("q <> nb"), k)
    # copies beyond the first k + 1 of a place: their nearest are the place's first k
    first = places.where(F.size("ids") > k).select("g", "vec", F.slice("ids", 1, k).alias("firsts"), F.element_at("ids", k + 1).alias("last"))
    rest = rows.join(first, ["g", "vec"]).where("id > last").select(F.col("id").alias("q"), F.explode("firsts").alias("nb"), F.lit(0.0).alias("d"))
    return every.unionByName(rest).select(F.col("q").alias("id"), F.col("nb").alias("neighbour"), F.col("d").alias("distance"))
