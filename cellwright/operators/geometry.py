"""Outlines of cells from the places of their molecules, and measures of polygons.

The pure functions work on the points of one cell (some hundreds); Spark groups, shuffles and parallelises the cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.runtime import parts, runs


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    half = []
    for seq in (pts, pts[::-1]):
        chain: list = []
        for p in seq:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        half += chain[:-1]
    return np.array(half)


def area_of(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def perimeter_of(ring: np.ndarray) -> float:
    return float(np.hypot(*(ring - np.roll(ring, -1, 0)).T).sum())


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles by incremental insertion: those whose circle holds the new point give way to a fan around it.

    Points come in the order of a coarse snake over the box, and a point's first triangle is found by walking from the last
    one made, so that the work grows little faster than the points.
    """
    n = len(points)
    mid, span = points.mean(0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    far = 1e4 * span
    pts = [tuple(p) for p in (points - mid).tolist()] + [(-far, -far), (far, -far), (0.0, far)]
    rows = max(1, math.isqrt(n) // 2)
    strip = np.minimum((points[:, 1] - points[:, 1].min()) / max(float(np.ptp(points[:, 1])), 1e-9) * rows, rows - 1).astype(int)
    order = np.lexsort((np.where(strip % 2, -points[:, 0], points[:, 0]), strip)).tolist()

    def circle(a, b, c):
        (ax, ay), (bx, by), (cx, cy) = pts[a], pts[b], pts[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-18:
            return (0.0, 0.0, math.inf)
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (aa * (by - cy) + bb * (cy - ay) + cc * (ay - by)) / d, (aa * (cx - bx) + bb * (ax - cx) + cc * (bx - ax)) / d
        return (ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2)

    # triangle -> circle; directed edge, counter-clockwise -> its triangle, so that the other direction is the neighbour
    live: dict[tuple, tuple] = {}
    edge: dict[tuple, tuple] = {}

    def add(a, b, c):
        t = (a, b, c)
        live[t] = circle(a, b, c)
        edge[a, b] = edge[b, c] = edge[c, a] = t
        return t

    last = add(n, n + 1, n + 2)
    side = lambda a, b, x, y: (pts[b][0] - pts[a][0]) * (y - pts[a][1]) - (pts[b][1] - pts[a][1]) * (x - pts[a][0])
    for i in order:
        x, y = pts[i]
        seen: set = set()
        while last not in seen:  # walk towards the point; a walk in circles ends at a triangle near it
            seen.add(last)
            for k in range(3):
                a, b = last[k], last[(k + 1) % 3]
                if side(a, b, x, y) < 0 and (b, a) in edge:
                    last = edge[b, a]
                    break
        holds = lambda t: (x - live[t][0]) ** 2 + (y - live[t][1]) ** 2 <= live[t][2] * (1 + 1e-12)
        gone, stack = set(), [last] if holds(last) else [t for t in live if holds(t)]
        while stack:
            t = stack.pop()
            if t in gone:
                continue
            gone.add(t)
            for k in range(3):
                o = edge.get((t[(k + 1) % 3], t[k]))
                if o is not None and o not in gone and holds(o):
                    stack.append(o)
        rim = [(t[k], t[(k + 1) % 3]) for t in gone for k in range(3) if edge.get((t[(k + 1) % 3], t[k])) not in gone]
        for t in gone:
            del live[t]
            for k in range(3):
                edge.pop((t[k], t[(k + 1) % 3]), None)
        for a, b in rim:
            last = add(a, b, i)
    return [t for t in live if max(t) < n]


def widest_gap(points: np.ndarray) -> float:
    """The largest distance of any point to its nearest other one: found in windows along the longer side, which grow for those not yet certain."""
    n = len(points)
    points = points[:, np.argsort(-np.ptp(points, axis=0))]  # along the longer side
    order = np.argsort(points[:, 0], kind="stable")
    x, y = points[order, 0], points[order, 1]
    best, lag = np.full(n, np.inf), 1
    live = np.arange(n)
    while len(live) and lag < n:
        for i, j in ((live[live + lag < n], live[live + lag < n] + lag), (live[live >= lag], live[live >= lag] - lag)):
            np.minimum.at(best, i, (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
        lag += 1
        right = np.where(live + lag < n, x[np.minimum(live + lag, n - 1)] - x[live], np.inf)
        left = np.where(live >= lag, x[live] - x[np.maximum(live - lag, 0)], np.inf)
        live = live[np.minimum(left, right) ** 2 < best[live]]
    return float(np.sqrt(best.max()))


def _angle(p, a, b) -> float:
    """Degrees of the corner ``p`` between ``a`` and ``b``; NaN for a zero side."""
    u, v = a - p, b - p
    n = np.linalg.norm(u) * np.linalg.norm(v)
    return math.degrees(math.acos(min(1.0, max(-1.0, float(u @ v / n))))) if n else math.nan


def outline(points: np.ndarray) -> list[np.ndarray]:
    """Rings around the points: triangulate, peel edges that are too long or too flat off the rim, walk what is left.

    A rim edge goes with its triangle if it is longer than twice the widest gap; then if it is longer than 1.5 gaps with an
    opposite corner over 90 degrees, or the corner is over 168.75 degrees, until the number of rim edges stays the same.
    """
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return []
    triangles = set(delaunay(points))
    gap = widest_gap(points)
    edges: dict[tuple, set] = {}
    for t in triangles:
        for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            edges.setdefault(tuple(sorted(e)), set()).add(t)
    length = lambda e: float(np.linalg.norm(points[e[0]] - points[e[1]]))

    def corner(e, t):
        p = next(i for i in t if i not in e)
        return _angle(points[p], points[e[0]], points[e[1]])

    def drop(e):
        (t,) = edges[e]
        for f in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            f = tuple(sorted(f))
            edges[f].discard(t)
            if not edges[f]:
                del edges[f]

    rim = lambda: [e for e, ts in edges.items() if len(ts) == 1]
    while long := [e for e in rim() if length(e) > 2 * gap]:
        for e in long:
            if e in edges and len(edges[e]) == 1:
                drop(e)
    before = -1
    while (now := len(rim())) != before:
        before = now
        for e in rim():
            if e in edges and len(edges[e]) == 1:
                c = corner(e, next(iter(edges[e])))
                if (length(e) > 1.5 * gap and c > 90) or c > 168.75:
                    drop(e)
    graph: dict[int, list] = {}
    for a, b in rim():
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, []).append(a)
    rings, seen = [], set()
    for start in sorted(graph):
        if start in seen:
            continue
        ring, stack = [], [start]
        while stack:
            v = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            ring.append(v)
            stack += sorted((w for w in graph[v] if w not in seen), reverse=True)
        if len(ring) >= 3:
            rings.append(points[ring])
    return rings


_OUTLINE = {"cell": pa.string(), "length": pa.int64(), "area": pa.float64(), "rings": pa.int32(), "xs": pa.list_(pa.float64()), "ys": pa.list_(pa.float64())}
_HULL = {"cell": pa.string(), "n": pa.int64(), "hull_perimeter": pa.float64(), "hull_area": pa.float64(), "corners": pa.int32()}


def _per_cell(points: DataFrame, run, columns: dict, schema: str) -> DataFrame:
    """``run(cell, places)`` -> row for every cell of (cell, x, y), over batches sorted by cell."""

    def batches(stream):
        for t in runs(stream, "key"):
            cell, xy = t["cell"].to_pylist(), np.column_stack([t["x"].to_numpy(), t["y"].to_numpy()])
            starts = [i for i in range(len(cell)) if not i or cell[i] != cell[i - 1]]  # sorted by key, then cell
            rows = [run(cell[a], xy[a:b]) for a, b in zip(starts, [*starts[1:], len(cell)])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(columns))

    n = parts(points.sparkSession, 4)
    return points.select("cell", "x", "y").repartition(n, "cell").select(F.xxhash64("cell").alias("key"), "cell", "x", "y").sortWithinPartitions("key", "cell").mapInArrow(batches, schema)


def cell_outlines(points: DataFrame) -> DataFrame:
    """(cell, length, area, rings, outline as nested arrays of the largest ring) of points (cell, x, y)."""

    def run(cell, xy):
        found = outline(xy)
        big = max(found, key=area_of, default=None)
        return {"cell": cell, "length": len(xy), "area": None if big is None else area_of(big), "rings": len(found), "xs": None if big is None else big[:, 0].tolist(), "ys": None if big is None else big[:, 1].tolist()}

    return _per_cell(points, run, _OUTLINE, "cell string, length long, area double, rings int, xs array<double>, ys array<double>")


def cell_hulls(points: DataFrame) -> DataFrame:
    """(cell, n, hull_perimeter, hull_area, corners); null for fewer than three places."""

    def run(cell, xy):
        h = hull(xy)
        ok = len(h) >= 3
        return {"cell": cell, "n": len(xy), "hull_perimeter": perimeter_of(h) if ok else None, "hull_area": area_of(h) if ok else None, "corners": len(h)}

    return _per_cell(points, run, _HULL, "cell string, n long, hull_perimeter double, hull_area double, corners int")


def shoelace(xs: str, ys: str) -> Column:
    """Area of the ring with corner arrays ``xs`` and ``ys``, inside Spark's expressions."""
    nx, ny = (F.concat(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, 1)) for c in (F.col(xs), F.col(ys)))
    cross = F.zip_with(F.zip_with(xs, ny, lambda a, b: a * b), F.zip_with(nx, ys, lambda a, b: a * b), lambda a, b: a - b)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line of corners."""
    if len(ring) < 3:
        return ring
    a, b = ring[0], ring[-1]
    ab = b - a
    n = np.linalg.norm(ab)
    d = np.abs(ab[0] * (ring[:, 1] - a[1]) - ab[1] * (ring[:, 0] - a[0])) / n if n else np.linalg.norm(ring - a, axis=1)
    i = int(d.argmax())
    if d[i] <= tolerance:
        return np.array([a, b])
    return np.vstack([simplify(ring[: i + 1], tolerance)[:-1], simplify(ring[i:], tolerance)])


def smooth(rings: DataFrame, tolerance: float) -> DataFrame:
    """Outlines (cell, xs, ys) with corners left out that lie within ``tolerance`` of the line between their neighbours."""

    def run(batches):
        for pdf in batches:
            out = [simplify(np.column_stack([x, y]), tolerance) for x, y in zip(pdf["xs"], pdf["ys"])]
            yield pdf.assign(xs=[o[:, 0].tolist() for o in out], ys=[o[:, 1].tolist() for o in out])[["cell", "xs", "ys"]]

    return rings.where("xs IS NOT NULL").select("cell", "xs", "ys").mapInPandas(run, "cell string, xs array<double>, ys array<double>")
