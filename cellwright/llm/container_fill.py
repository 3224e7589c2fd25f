"""Filling containers of a fixed capacity with items of varying length.

Method: items are only counted by length (a histogram of at most ``capacity`` rows, whatever the number of items). Its
configuration linear program - how many containers to give to each multiset of lengths that fits, so that every length is
covered - is solved by multiplicative weights. Every length has a price, at first its share of a container. A knapsack by
dynamic programming prices configurations: its table tells how much any choice falls short of the best container under these
prices, and the round draws its configurations from the choices that fall short by little, in proportion to what is still
uncovered. They get an equal share of the containers each, no more than the rarest length in them can use. Then prices
fall exponentially with the share of its demand that each length was given. Prices over the best container's worth are a
lower bound on the containers of any packing; the largest of all rounds is reported.

The fractional solution is the sum over all rounds. It is rounded down, then up where the demand left allows a whole
container. Only what this leaves is placed by best fit, first into the room that configurations left free. Items find their
containers by their rank within their length, in Spark: ranks come from counts per length and hash slice, so a length which a
third of all items have is ranked in slices, and each rank falls into the run of equal containers that the plan gave it.

An item longer than the capacity is cut into pieces of exactly the capacity, and the rest is an item of its own.

Defined results: items of null id take no part; items of no length (null, empty text) need no room: they come out with
container null; ids that come twice are items each; ties don't matter, the plan depends on the histogram only; an empty
table gives no rows; the output is (id, piece, container, start, length): piece numbers count from 0, ``start`` is the
offset within the item.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.runtime import cut, parts

#: Configurations that the fractional solution is spread over, at least one container each, the rounds that draw them, and rounds in vain that end it.
DRAWS, ROUNDS, VAIN = 2048, 48, 12
#: Worth, in containers, by which a likely choice falls short of the best; the exponent by which a covered length's price falls.
SLACK, RATE = 0.0005, 0.06


class Plan(NamedTuple):
    """Configurations as (counts per length, containers); the lower bound; tokens that rounded configurations hold."""

    configurations: list
    bound: float
    by_configuration: int


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Worth of the best multiset of ``sizes`` (rising) for every room from 0 to ``capacity``."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        k = upto[c]
        best[c] = max(best[c - 1], (prices[:k] + best[c - sizes[:k]]).max())
    return best


def draw(best, prices, sizes, share, capacity: int, n: int, slack: float, rng) -> np.ndarray:
    """``n`` configurations as counts per size: at every room a size is drawn by its share and by how little worth it loses."""
    counts, room, rows = np.zeros((n, len(sizes)), np.int64), np.full(n, capacity), np.arange(n)
    while True:
        rows = rows[room[rows] >= sizes[0]]
        if not len(rows):
            return counts
        left = room[rows, None] - sizes[None]
        loss = np.where(left >= 0, best[room[rows], None] - prices - best[np.maximum(left, 0)], np.inf)
        odds = np.cumsum(share * np.exp((loss.min(1, keepdims=True) - loss) / slack), 1)
        pick = (odds < rng.random(len(rows))[:, None] * odds[:, -1:]).sum(1)
        counts[rows, pick] += 1
        room[rows] -= sizes[pick]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, seed: int = 1):
    """(fractional solution {configuration: containers}, lower bound) of the configuration program; sizes rising."""
    rng, x, bound, vain = np.random.default_rng(seed), {}, 0.0, 0
    need, volume = demand.astype(float), float((sizes * demand).sum()) / capacity
    prices = sizes / capacity
    step = max(1.0, volume / DRAWS)
    each = max(1, int(np.ceil(volume / step / ROUNDS)))
    while (need * sizes).sum() >= capacity and vain < VAIN:
        some = np.flatnonzero(need >= 1)
        if not len(some):
            break
        best = knapsack(prices[some], sizes[some], capacity)
        if len(some) == len(sizes):
            bound = max(bound, float(demand @ prices) / best[-1])
        given = np.zeros(len(sizes))
        for row in draw(best, prices[some], sizes[some], need[some], capacity, each, SLACK, rng):
            at = np.flatnonzero(row)
            much = min(step, float((need[some[at]] / row[at]).min()))
            if much >= 1:  # the rarest length in it can fill whole containers
                counts = np.zeros(len(sizes), np.int64)
                counts[some] = row
                key = counts.tobytes()
                x[key] = x.get(key, 0.0) + much
                need[some[at]] -= row[at] * much
                given[some[at]] += row[at] * much
        vain = 0 if given.any() else vain + 1  # the lengths left over make no whole container, or hardly ever
        prices = prices * np.exp(-RATE * given / demand)
        prices = prices / (demand @ prices) * volume
    return x, max(bound, volume)


def rounded(x: dict, sizes, demand, capacity: int):
    """Whole containers per configuration, and what they leave of the demand: down, then up where the demand allows it."""
    left, out = demand.copy(), []
    shares = [(np.frombuffer(key, np.int64), v) for key, v in x.items()]
    for counts, v in shares:
        n = int(v + 1e-9)
        left -= counts * n
        out.append(n)
    for i in sorted(range(len(shares)), key=lambda i: out[i] - shares[i][1]):
        counts, v = shares[i]
        if v - out[i] > 1e-9 and (left >= counts).all():
            left -= counts
            out[i] += 1
    return [(c, n) for (c, _), n in zip(shares, out) if n], left


def best_fit(configurations, sizes, left, capacity: int):
    """``left`` placed longest first where it leaves least room; containers alike are one entry, told apart by their room."""
    rooms: dict[int, dict[bytes, int]] = {}

    def put(counts, n):
        room = capacity - int((counts * sizes).sum())
        same = rooms.setdefault(room, {})
        same[counts.tobytes()] = same.get(counts.tobytes(), 0) + n

    for counts, n in configurations:
        put(counts, n)
    for i in np.argsort(-sizes):
        n, s = int(left[i]), int(sizes[i])
        while n:
            fit = min((r for r in rooms if r >= s), default=capacity)
            base, have = next(iter(rooms[fit].items())) if rooms.get(fit) else (np.zeros(len(sizes), np.int64).tobytes(), n)
            per = min(fit // s, n)
            many = min(have, n // per)
            if rooms.get(fit):
                rooms[fit][base] -= many
                if not rooms[fit][base]:
                    del rooms[fit][base]
                if not rooms[fit]:
                    del rooms[fit]
            counts = np.frombuffer(base, np.int64).copy()
            counts[i] += per
            put(counts, many)
            n -= many * per
    return [(np.frombuffer(key, np.int64), n) for same in rooms.values() for key, n in same.items() if n]


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Configurations that hold every item once and never overfill; ``sizes`` rising, at most ``capacity``."""
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    if not len(sizes):
        return Plan([], 0.0, 0)
    x, bound = solve(sizes, demand, capacity)
    whole, left = rounded(x, sizes, demand, capacity)
    return Plan(best_fit(whole, sizes, left, capacity), bound, int(((demand - left) * sizes).sum()))


def slots(sizes, configurations) -> dict[int, tuple]:
    """Per size: first rank, first container and items per container of each run of containers that hold it."""
    out: dict[int, list] = {int(s): [] for s in sizes}
    at, base = dict.fromkeys(out, 0), 0
    for counts, n in configurations:
        for i in np.flatnonzero(counts):
            s = int(sizes[i])
            out[s].append((at[s], base, int(counts[i])))
            at[s] += int(counts[i]) * n
        base += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in out.items() if rows}


def pieces(items: DataFrame, id_col: str, length: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) of all items with an id, and (id, piece, start, length) of the pieces that need room."""
    base = cut(items.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("long").alias("n")).where("id IS NOT NULL"))
    cap = F.lit(capacity).cast("long")
    piece = base.where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / cap))).alias("piece"))
    return base, piece.select("id", "piece", (F.col("piece") * cap).alias("start"), F.least(cap, F.col("n") - F.col("piece") * cap).alias("length"))


def histogram(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, rising, and how many pieces have them, from (length, count): at most ``capacity`` rows."""
    rows = counted.groupBy("length").agg(F.sum("count").alias("n")).orderBy("length").collect()
    return np.array([r["length"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def pack(items: DataFrame, id_col: str, length: str, capacity: int) -> tuple[DataFrame, Plan]:
    """(id, piece, container, start, length) of every item, and the plan behind it; see the module's text."""
    spark = items.sparkSession
    base, piece = pieces(items, id_col, length, capacity)
    piece = piece.withColumn("slice", F.pmod(F.xxhash64("id", "piece"), F.lit(4 * parts(spark))))
    cells = cut(piece.groupBy("length", "slice").count())
    sizes, demand = histogram(cells)
    made = plan(sizes, demand, capacity)
    where = spark.sparkContext.broadcast(slots(sizes, made.configurations))  # bounded by draws and capacity
    before = F.sum("count").over(Window.partitionBy("length").orderBy("slice")) - F.col("count")
    offsets = cells.select("length", "slice", before.alias("before"))
    ranked = piece.withColumn("r", F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "slice"]).select("id", "piece", "start", "length", (F.col("before") + F.col("r")).alias("rank"))

    def place(batches):
        for b in batches:
            size, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            box = np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, start, each = where.value[int(s)]
                run = np.searchsorted(first, rank[at], "right") - 1
                box[at] = start[run] + (rank[at] - first[run]) // each[run]
            yield pa.RecordBatch.from_arrays([b["id"], b["piece"], pa.array(box), b["start"], b["length"]], ["id", "piece", "container", "start", "length"])

    kind = dict(base.dtypes)["id"]
    packed = ranked.mapInArrow(place, f"id {kind}, piece long, container long, start long, length long")
    zero = F.lit(0).cast("long")
    none = base.where("n <= 0").select("id", zero.alias("piece"), F.lit(None).cast("long").alias("container"), zero.alias("start"), zero.alias("length"))
    return packed.unionByName(none), made


def fill_containers(items: DataFrame, id_col: str, length: str, capacity: int) -> DataFrame:
    """(id, piece, container, start, length) of every item."""
    return pack(items, id_col, length, capacity)[0]
