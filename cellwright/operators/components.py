"""Principal components of sparse rows, and exact nearest neighbours in many dimensions.

The second moments of a matrix of few values per row are sparse too: they are summed from the pairs of values of each row, and
their leading eigenvectors are found without filling the matrix, so that columns that occur in few rows cost little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators.knn import matrix

#: Columns up to which all eigenvectors are found from the full matrix; columns whose moments are held as dense rows beyond that.
DENSE, HEAVY = 2048, 512
#: Pairs of values put together at once; queries in one block of a search, and distances in one of its matrices.
PAIRS, QUERIES, CELLS = 2_000_000, 65_536, 16_000_000


def components_to_keep(shares, share: float | None = None) -> int:
    """How many components: where their cumulative variance is nearest to ``share``, by default at its knee; one at least."""
    c = np.cumsum(shares)
    if share is not None:
        return max(1, int(np.abs(c - share).argmin()))
    run, rise = len(c) - 1, c[-1] - c[0]
    return max(1, int(np.abs(run * (c - c[0]) - rise * np.arange(len(c))).round(9).argmax()))


def _lists(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of a batch's rows, and their places and values one after the other."""
    i, v = batch.column("i"), batch.column("v")
    return np.diff(i.offsets.to_numpy()), i.flatten().to_numpy(), v.flatten().to_numpy()


def _moments(p: int):
    def run(batches):
        for b in batches:
            size, i, v = _lists(b)
            ends, rank = np.cumsum(size), np.arange(len(i))
            starts = np.repeat(ends - size, size)
            many = np.cumsum(rank - starts + 1)  # each value meets itself and those before it in its row
            cuts = np.searchsorted(many, np.arange(PAIRS, many[-1] if len(many) else 0, PAIRS))
            for part in np.split(rank, cuts):
                times = part - starts[part] + 1
                second = np.repeat(part, times)
                first = np.arange(len(second)) - np.repeat(np.cumsum(times) - times, times) + starts[second]
                key, at = np.unique(i[first].astype(np.int64) * p + i[second], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // p), pa.array(key % p), pa.array(np.bincount(at, v[first] * v[second], len(key)))], ["a", "b", "s"])

    return run


def principal_axes(rows: DataFrame, p: int, share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(axes, mean): the axes of largest variance of sparse rows (i: rising places among ``p``, v: values), as many columns as
    :func:`components_to_keep` says, and the mean of the rows. Sums of pairs of columns that meet come to the driver.
    """
    n, m = rows.count(), np.zeros(p)
    sums = rows.select(F.explode(F.arrays_zip("i", "v")).alias("e")).groupBy("e.i").agg(F.sum("e.v").alias("s")).toArrow()
    m[sums["i"].to_numpy()] = sums["s"].to_numpy() / max(n, 1)
    t = rows.mapInArrow(_moments(p), "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).toArrow()
    a, b, s = (t[c].to_numpy() for c in ("a", "b", "s"))
    s = s / max(n, 1)
    return leading_axes(a, b, s, m, share, most=n), m


def leading_axes(a: np.ndarray, b: np.ndarray, s: np.ndarray, mean: np.ndarray, share: float | None = None, dense: int = DENSE, heavy: int = HEAVY, most: int | None = None) -> np.ndarray:
    """Leading eigenvectors of the covariance (a, b, s: second moments, a <= b, absent ones are zero), those to be kept.

    There are as many components as columns, or as rows (``most``) where these are fewer.
    """
    p, diagonal = len(mean), a == b
    total = max(float(s[diagonal].sum() - (mean**2).sum()), 1e-300)
    if p <= dense:
        c = -np.outer(mean, mean)
        c[a, b] += s
        c[b[~diagonal], a[~diagonal]] += s[~diagonal]
        w, x = np.linalg.eigh(c)
        return x[:, ::-1][:, : components_to_keep(w[::-1][:most] / total, share)]
    times = _product(np.r_[a, b[~diagonal]], np.r_[b, a[~diagonal]], np.r_[s, s[~diagonal]], mean, heavy)
    width = min(p, heavy)
    while True:
        w, x = _subspace(times, p, width, 0.8 * width)
        rest = np.full(p - width, max(0.0, 1 - w.sum() / total) / max(1, min(p, most or p) - width))  # no single one of them matters for the knee
        k = components_to_keep(np.r_[w / total, rest][:most], share)
        if width == p or k <= 0.8 * width:
            return x[:, :k]
        width = min(p, 2 * width)


def _product(a, b, s, mean, heavy):
    """x -> covariance times x: dense rows for the columns that meet most others, sums over entries for what is left."""
    p = len(mean)
    top = np.sort(np.argsort(-np.bincount(a, minlength=p), kind="stable")[:heavy])
    place = np.full(p, -1)
    place[top] = np.arange(len(top))
    wide = np.zeros((p, len(top)))
    hit = place[b] >= 0
    wide[a[hit], place[b[hit]]] = s[hit]
    low = ~hit & (place[a] < 0)
    light = np.flatnonzero(place < 0)
    a, b, s = a[low], b[low], s[low]
    order = np.argsort(a, kind="stable")
    slices = np.array_split(order, max(1, len(order) // 20_000))

    def times(x: np.ndarray) -> np.ndarray:
        out = wide @ x[top] - np.outer(mean, mean @ x)
        out[top] += wide[light].T @ x[light]
        for o in slices:
            if len(o):
                starts = np.flatnonzero(np.diff(a[o], prepend=-1))
                out[a[o][starts]] += np.add.reduceat(s[o, None] * x[b[o]], starts)
        return out

    return times


def _subspace(times, p: int, width: int, sure: float):
    """Largest eigenvalues, falling, and their vectors, by iteration of a subspace until those up to ``sure`` no longer move."""
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(p, width)))[0]
    for _ in range(500):
        y = times(x)
        w, u = np.linalg.eigh(x.T @ y)
        w, u = w[::-1], u[:, ::-1]
        x, y = x @ u, y @ u
        if width == p or (np.linalg.norm(y - x * w, axis=0)[: int(sure)] <= 1e-6 * w[0]).all():
            break
        x = np.linalg.qr(y)[0]
    return w, x


def on_axes(rows: DataFrame, axes: np.ndarray, mean: np.ndarray, *keys: str) -> DataFrame:
    """(keys, vec): the centred sparse rows on the axes, single precision."""
    told = rows.sparkSession.sparkContext.broadcast((axes, mean @ axes))

    def run(batches):
        for b in batches:
            axes, off = told.value
            size, i, v = _lists(b)
            out, has = np.tile(-off, (len(size), 1)), np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[has]
            for part in np.array_split(np.arange(len(has)), max(1, len(i) * len(off) // CELLS)):
                if len(part):
                    low, high = starts[part[0]], starts[part[-1]] + size[has[part[-1]]]
                    out[has[part]] += np.add.reduceat(axes[i[low:high]] * v[low:high, None], starts[part] - low)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(off)), pa.array(out.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), vec], [*keys, "vec"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "i", "v").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "vec array<float>"]))


def _nearest(k: int, skip_self: bool):
    """The queries of a partition, which come first, against all vectors of the stream."""

    def run(batches):
        held, q = [], None
        for b in batches:
            vector = b.column("vector").to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(vector, True))
            if split:
                held.append(b.slice(0, split))
            if split == b.num_rows:
                continue
            if q is None:
                if not held:
                    return
                t = pa.Table.from_batches(held)
                q, qids = np.hstack([matrix(t["v"]).astype(np.float32), np.ones((t.num_rows, 1), np.float32)]), t["id"].to_numpy()
                near, d = np.full((len(q), k), -1), np.full((len(q), k), np.inf, np.float32)
                step, found, waiting = 4 * k, [], 0
            t = pa.Table.from_batches([b.slice(split)])
            x, ids = matrix(t["v"]).astype(np.float32), t["id"].to_numpy()
            x = np.hstack([-2 * x, (x * x).sum(1, keepdims=True)])
            at = 0
            while at < len(x):
                far = q @ x[at : at + step].T  # squared distances, less the square of the query
                i, j = np.divmod(np.flatnonzero(far <= d[:, -1:]), far.shape[1])
                got = ids[at + j]
                other = got != qids[i] if skip_self else slice(None)
                found.append((i[other], got[other], far[i, j][other]))
                waiting += len(i)
                at += step
                if waiting > len(q) * k:
                    near, d = _merge(near, d, found, k)
                    found, waiting, step = [], 0, max(1, min(2 * step, CELLS // len(q)))
        if q is not None:
            near, d = _merge(near, d, found, k)
            i, j = np.nonzero(near >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(near[i, j]), pa.array(np.sqrt(np.maximum(d[i, j].astype(float) + (q[i, :-1] ** 2).sum(1), 0)))], ["qid", "id", "d"])

    return run


def _merge(near, d, found, k):
    n = len(near)
    old_i, old_j = np.nonzero(near >= 0)
    i, v, e = (np.concatenate(c) for c in zip((old_i, near[old_i, old_j], d[old_i, old_j]), *found))
    order = np.lexsort((v, e, i))
    i, v, e = i[order], v[order], e[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    ok = rank < k
    near, d = np.full((n, k), -1), np.full((n, k), np.inf, np.float32)
    near[i[ok], rank[ok]], d[i[ok], rank[ok]] = v[ok], e[ok]
    return near, d


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, skip_self: bool = False) -> DataFrame:
    """(qid, id, d): the k nearest vectors (id, v) of every query (qid, v); ties go to the smaller id.

    Distances are of single precision: of those below about a thousandth of a vector's length, only that they are small is known.
    A task holds a block of the queries and reads all vectors once, in matrix products. So the work is queries times
    vectors, and the vectors are sent once for each block.
    """
    n = queries.count()
    blocks = max(min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 256)), -(-n // QUERIES), 1)
    row = lambda df, i, v, vector, b: df.select(b.alias("b"), F.lit(vector).alias("vector"), F.col(i).cast("long").alias("id"), F.col(v).cast("array<float>").alias("v"))
    asked = row(queries, "qid", "v", False, F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    sent = row(vectors, "id", "v", True, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = asked.unionByName(sent).repartitionById(blocks, "b").sortWithinPartitions("vector").drop("b")
    return rows.mapInArrow(_nearest(k, skip_self), "qid long, id long, d double")
