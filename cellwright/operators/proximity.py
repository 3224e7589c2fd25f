"""Points near other points, and the regions that contain points.

Method: the second axis is range-partitioned into strips of about equal numbers of points, strips that are still too
full are range-partitioned along the first axis too, each part also receives the points within ``radius`` above (and right
of) it, and every part is sorted by x and swept with an active window of width ``radius``. A pair is emitted only by the
part that is home to its lower point (in y) and, within that strip, to its left point (in x), so each pair comes out once.
Regions go to every part that their bounding box touches and are tested against that part's own points only.

Defined results: rows with a null id, null frame or unusable location (null, NaN, infinite, negative) match nothing; rows
repeated under one id count once; different ids at one place are a pair at distance 0; points exactly ``radius`` apart
are a pair; a region needs three different corners; corners that lack a coordinate are skipped, repeated and doubled
corners, either direction and open or closed rings make no difference; a point on an outline may count as either side.
Inputs may carry any further columns. Empty inputs give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.runtime import cut, parts, usable

SCHEMA = "kind string, id long, match string"
#: Points per strip, and twice as many per block of a strip; edges tested at once in a task.
STRIP_POINTS, EDGES_AT_ONCE = 50_000, 2_000_000


def _strips(points: DataFrame, step: float, most: int) -> DataFrame:
    """(frame, row) -> strip, its lower edge and the strip below it; strips hold about ``most`` points."""
    rows = points.groupBy("frame", F.floor(F.col("y") / step).alias("row")).count()
    w = Window.partitionBy("frame").orderBy("row")
    rows = rows.withColumn("strip", F.floor((F.sum("count").over(w) - F.col("count")) / most))
    low = F.min("row").over(Window.partitionBy("frame", "strip"))
    below = F.max("strip").over(w.partitionBy("frame").orderBy("strip").rangeBetween(Window.unboundedPreceding, -1))
    return rows.select("frame", "row", "strip", (low * step).alias("low"), below.alias("below"))


def _blocks(homes: DataFrame, step: float, most: int) -> DataFrame:
    """(frame, strip) -> left edges of its blocks; a strip that isn't overfull has one block."""
    cols = homes.groupBy("frame", "strip", F.floor(F.col("x") / step).alias("col")).count()
    w = Window.partitionBy("frame", "strip").orderBy("col")
    cols = cols.withColumn("block", F.floor((F.sum("count").over(w) - F.col("count")) / most))
    cuts = cols.groupBy("frame", "strip", "block").agg((F.min("col") * step).alias("left"))
    return cuts.groupBy("frame", "strip").agg(F.sort_array(F.collect_list("left")).alias("lefts"))


def _block_of(x):
    """Index of the last block whose left edge is not right of x (0 for points left of all)."""
    return F.greatest(F.lit(0), F.size(F.filter("lefts", lambda e: e <= x)) - 1)


def _rings(corners: DataFrame) -> DataFrame:
    ok = corners.where(F.col("frame").isNotNull() & F.col("region").isNotNull() & F.col("no").isNotNull())
    for c in ("vx", "vy"):
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ring = F.sort_array(F.collect_set(F.struct("no", "vx", "vy")))
    rings = ok.groupBy("frame", "region").agg(ring.alias("ring"))
    xy = F.array_distinct(F.transform("ring", lambda c: F.struct(c["vx"], c["vy"])))
    return rings.where(F.size(xy) >= 3).select(
        "frame", "region", F.col("ring.vx").alias("xs"), F.col("ring.vy").alias("ys")
    )


def sweep_pairs(ids, x, y, home_y, home_x, radius: float):
    """Pairs of rows sorted by x, at most ``radius`` apart, that this part owns: (smaller id, larger id)."""
    out_a, out_b = [], []
    n, lag = len(x), 1
    live = np.arange(n)
    while True:
        live = live[live + lag < n]
        live = live[x[live + lag] - x[live] <= radius]  # the active window, one step wider each round
        if not len(live):
            break
        a, b = live, live + lag
        dx, dy = x[b] - x[a], y[b] - y[a]
        near = (np.abs(dy) <= radius) & (dx * dx + dy * dy <= radius * radius)
        a, b, dy, dx = a[near], b[near], dy[near], dx[near]
        a_low = (dy > 0) | ((dy == 0) & (ids[a] < ids[b]))
        a_left = (dx > 0) | (ids[a] < ids[b])
        own = np.where(a_low, home_y[a], home_y[b]) & np.where(a_left, home_x[a], home_x[b])
        a, b = ids[a[own]], ids[b[own]]
        out_a.append(np.minimum(a, b))
        out_b.append(np.maximum(a, b))
        lag += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def points_in_rings(x, y, start, px, py):
    """(point index, ring index) by the even-odd rule; points sorted by x; ring k has corners start[k]:start[k+1]."""
    n_rings, sizes = len(start) - 1, np.diff(start)
    if not n_rings or not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = start[:-1]
    x0, x1, y0, y1 = (f.reduceat(v, at) for f, v in ((np.minimum, px), (np.maximum, px), (np.minimum, py), (np.maximum, py)))
    lo, hi = np.searchsorted(x, x0, "left"), np.searchsorted(x, x1, "right")
    pts, rgs = [], []
    ends = np.cumsum((hi - lo) * 1)
    first = 0
    while first < n_rings:  # rings by the million candidates, to bound memory
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + EDGES_AT_ONCE, "right")))
        k = np.repeat(np.arange(first, last), hi[first:last] - lo[first:last])
        i = np.arange(len(k)) - np.repeat(ends[first:last] - (hi - lo)[first:last] - base, (hi - lo)[first:last]) + lo[k]
        box = (y[i] >= y0[k]) & (y[i] <= y1[k])
        pts.append(i[box])
        rgs.append(k[box])
        first = last
    i, k = np.concatenate(pts), np.concatenate(rgs)
    nxt = np.arange(len(px)) + 1
    nxt[start[1:] - 1] = at
    inside = np.zeros(len(i), bool)
    edge_ends = np.cumsum(sizes[k])
    first = 0
    while first < len(i):
        base = edge_ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(edge_ends, base + EDGES_AT_ONCE, "right")))
        kk, s = k[first:last], sizes[k[first:last]]
        begin = np.cumsum(s) - s
        e = np.arange(s.sum()) - np.repeat(begin, s) + np.repeat(at[kk], s)
        qx, qy = np.repeat(x[i[first:last]], s), np.repeat(y[i[first:last]], s)
        ax, ay, bx, by = px[e], py[e], px[nxt[e]], py[nxt[e]]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = ((ay > qy) != (by > qy)) & (qx < (bx - ax) * (qy - ay) / (by - ay) + ax)
        inside[first:last] = np.add.reduceat(cross.astype(np.int64), begin) % 2 == 1
        first = last
    return i[inside], k[inside]


def _sweep(radius: float):
    def run(points: pa.Table, regions: pa.Table) -> pa.Table:
        ids = points["id"].to_numpy()
        _, one = np.unique(ids, return_index=True)  # a repeated row lies where its first delivery lies
        x, y = points["x"].to_numpy()[one], points["y"].to_numpy()[one]
        order = np.lexsort((ids[one], x))
        ids, x, y = ids[one][order], x[order], y[order]
        home_y = points["home_y"].to_numpy(zero_copy_only=False)[one][order]
        home_x = points["home_x"].to_numpy(zero_copy_only=False)[one][order]
        a, b = sweep_pairs(ids, x, y, home_y, home_x, radius)
        own = np.flatnonzero(home_y & home_x)
        i = k = np.empty(0, np.int64)
        if regions.num_rows:
            xs = regions["xs"].combine_chunks()
            start = np.concatenate(([0], np.cumsum(xs.value_lengths().to_numpy())))
            i, k = points_in_rings(
                x[own], y[own], start, xs.flatten().to_numpy(), regions["ys"].combine_chunks().flatten().to_numpy()
            )
        kind = pa.DictionaryArray.from_arrays(np.repeat([0, 1], [len(a), len(i)]).astype(np.int8), ["near", "inside"])
        match = [pa.array(b).cast(pa.string()), regions["region"].combine_chunks().take(pa.array(k)).cast(pa.string())]
        return pa.table(
            {"kind": kind.cast(pa.string()), "id": np.concatenate([a, ids[own[i]]]), "match": pa.concat_arrays(match)}
        )

    return run


def nearby(
    points: DataFrame,
    corners: DataFrame,
    radius: float,
    *,
    id_col: str,
    frame: str,
    x: str,
    y: str,
    region: str,
    order: str,
    vx: str,
    vy: str,
    strip_points: int = STRIP_POINTS,
) -> DataFrame:
    """Rows (kind 'near', smaller id, larger id as string) and (kind 'inside', id, region); see the module's text."""
    n, q = parts(points.sparkSession), lambda c: f"`{c}`"
    pts = points.select(
        F.col(q(id_col)).cast("long").alias("id"),
        F.col(q(frame)).alias("frame"),
        F.col(q(x)).cast("double").alias("x"),
        F.col(q(y)).cast("double").alias("y"),
    ).where(usable(F.col("x"), F.col("y")) & F.col("id").isNotNull() & F.col("frame").isNotNull())
    step = max(16 * radius, 1e-9)
    strips = cut(_strips(pts, step, strip_points))  # a row per strip of 16 radii: written once, so that points needn't move to meet it where it is small
    homes = pts.withColumn("row", F.floor(F.col("y") / step)).join(strips, ["frame", "row"])
    blocks = cut(_blocks(homes.select("frame", "strip", "x"), step, 2 * strip_points))
    ghost = F.when(F.col("below").isNotNull() & (F.col("y") <= F.col("low") + radius), F.array("strip", "below"))
    placed = (
        homes.select("id", "frame", "x", "y", F.col("strip").alias("home"), F.explode(F.coalesce(ghost, F.array("strip"))).alias("strip"))
        .join(blocks, ["frame", "strip"])
        .withColumn("b", _block_of(F.col("x")))
        .withColumn("edge", F.element_at("lefts", F.col("b").cast("int") + 1))
    )
    both = F.when((F.col("b") > 0) & (F.col("x") <= F.col("edge") + radius), F.array(F.col("b"), F.col("b") - 1))
    placed = placed.select(
        "id", "frame", "x", "y", "strip",
        (F.col("home") == F.col("strip")).alias("home_y"),
        "b",
        F.explode(F.coalesce(both, F.array("b"))).alias("block"),
    ).select("frame", "strip", "block", "id", "x", "y", "home_y", (F.col("b") == F.col("block")).alias("home_x"))
    rings = _rings(
        corners.select(
            F.col(q(frame)).alias("frame"),
            F.col(q(region)).alias("region"),
            F.col(q(order)).alias("no"),
            F.col(q(vx)).cast("double").alias("vx"),
            F.col(q(vy)).cast("double").alias("vy"),
        )
    )
    rows_of = F.sequence(F.floor(F.array_min("ys") / step), F.floor(F.array_max("ys") / step))
    touched = (
        rings.select("frame", "region", F.explode(rows_of).alias("row"))
        .join(strips.select("frame", "row", "strip"), ["frame", "row"])
        .select("frame", "region", "strip")
        .distinct()
    )
    routed = (
        rings.join(touched, ["frame", "region"])
        .join(blocks, ["frame", "strip"])
        .withColumn("block", F.explode(F.sequence(_block_of(F.array_min("xs")), _block_of(F.array_max("xs")))))
        .select("frame", "strip", "block", "region", "xs", "ys")
    )
    key = ["frame", "strip", "block"]
    return (
        placed.repartition(n, *key)
        .groupBy(*key)
        .cogroup(routed.repartition(n, *key).groupBy(*key))
        .applyInArrow(_sweep(radius), SCHEMA)
    )
