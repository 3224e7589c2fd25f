"""Orders and modules of few things (types, chosen genes) from their pairwise similarity.

The similarities come from Spark aggregates over all cells. Only the matrix of the things themselves is put in one task; its
size is set by the caller (a list of types or the top k genes) and is refused beyond ``MOST``. Genes in blocks need no
matrix, so any number of them is ordered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Things in one matrix at most: a larger one is an error, not a slow task.
MOST = 2000


def linkage_groups(near: np.ndarray, how: str, least: float = -np.inf) -> list[list[int]]:
    """Merges the two most similar groups until none are at least ``least`` alike; a group lists its members in leaf order.

    ``how`` is single, complete or average. Equal similarities go to the groups with the smaller first members.
    """
    n = len(near)
    groups = [[i] for i in range(n)]
    sim = near.astype(float).copy()
    np.fill_diagonal(sim, -np.inf)
    while len(groups) > 1:
        i, j = sorted(divmod(int(np.argmax(sim)), len(groups)))
        if not sim[i, j] >= least or sim[i, j] == -np.inf:
            break
        a, b = len(groups[i]), len(groups[j])
        if how == "single":
            row = np.maximum(sim[i], sim[j])
        elif how == "complete":
            row = np.minimum(sim[i], sim[j])
        else:
            row = (a * sim[i] + b * sim[j]) / (a + b)
        groups[i] = groups[i] + groups[j]
        sim[i], sim[:, i] = row, row
        sim[i, i] = -np.inf
        sim = np.delete(np.delete(sim, j, 0), j, 1)
        del groups[j]
    return groups


def _square(pdf: pd.DataFrame, a: str, b: str, value: str) -> tuple[list, np.ndarray]:
    names = sorted(set(pdf[a]) | set(pdf[b]))
    if len(names) > MOST:
        raise ValueError(f"{len(names)} things to order, at most {MOST}")
    at = {x: i for i, x in enumerate(names)}
    m = np.full((len(names), len(names)), -1.0)
    i, j, v = pdf[a].map(at).to_numpy(), pdf[b].map(at).to_numpy(), pdf[value].fillna(-1.0).to_numpy()
    m[i, j] = m[j, i] = v
    return names, m


def leaf_positions(pairs: DataFrame, a: str = "g1", b: str = "g2", value: str = "r") -> DataFrame:
    """(thing, place, position): leaf order of single linkage, and the cumulative distance between neighbours scaled to 0..1.

    A thing that is in no pair isn't placed; a missing or null similarity counts as -1; one place per thing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _square(pdf, a, b, value)
        order = [i for g in linkage_groups(m, "single") for i in g]
        steps = np.r_[0.0, np.cumsum([1.0 - m[i, j] for i, j in zip(order, order[1:])])]
        scale = steps[-1] if len(steps) > 1 and steps[-1] > 0 else 1.0
        return pd.DataFrame({"thing": [names[i] for i in order], "place": np.arange(len(order)), "position": steps / scale})

    return pairs.select(a, b, F.col(value).cast("double").alias(value)).groupBy().applyInPandas(run, "thing string, place int, position double")


def single_leaves(n: int, row) -> list[int]:
    """Leaf order of n things, the one that ``linkage_groups(..., "single")`` gives, without their matrix.

    ``row(i)`` makes the similarities of thing i to all. A walk along the most similar edges has the groups of every
    similarity as its runs; where more than two groups meet at one, its edges are looked up again for the order.
    """
    walk, entry = [0], np.full(n, np.inf)
    best, seen = row(0).astype(float), np.zeros(n, bool)
    for p in range(1, n):
        seen[walk[-1]] = True
        best[seen] = -np.inf
        walk.append(int(np.argmax(best)))
        entry[p] = best[walk[-1]]
        np.maximum(best, row(walk[-1]), out=best)
    leaves, first, last = [[i] for i in walk], np.arange(n), np.arange(n)  # of the run that begins or ends at a place of the walk
    order = np.argsort(-entry[1:], kind="stable") + 1
    for same in np.split(order, np.flatnonzero(np.diff(entry[order])) + 1) if n > 1 else ():
        for meet in np.split(np.sort(same), _gaps(np.sort(same), last)):
            starts = [int(first[meet[0] - 1]), *map(int, meet)]
            groups = sorted((leaves[p] for p in starts), key=lambda g: g[0])
            end = int(last[starts[-1]])
            leaves[starts[0]] = [i for g in (groups if len(groups) == 2 else _absorbed(groups, entry[meet[0]], row)) for i in g]
            last[starts[0]], first[end] = end, starts[0]
    return leaves[0]


def _gaps(starts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where in rising ``starts`` a run doesn't begin right behind the end of the one before."""
    return np.flatnonzero(last[starts[:-1]] + 1 != starts[1:]) + 1


def _absorbed(groups: list[list[int]], level: float, row) -> list[list[int]]:
    """Groups that are connected by similarities equal to ``level``, in the order in which the first takes in the others: always the one with the smallest first member."""
    members = np.concatenate([np.array(g) for g in groups])
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    met, left, out, k = np.zeros(len(groups), bool), np.ones(len(groups), bool), [], 0
    met[0] = True
    while True:
        out.append(groups[k])
        left[k] = False
        for i in groups[k]:
            if met.all():
                break
            met[of[row(i)[members] == level]] = True
        if not left.any():
            return out
        k = int(np.argmax(met & left))


def _leaves_of_block(genes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    genes = genes.sort_values("gene", ignore_index=True)
    n, at = len(genes), {x: i for i, x in enumerate(genes.gene)}
    i, j, r = pairs.g1.map(at).to_numpy(np.int64), pairs.g2.map(at).to_numpy(np.int64), pairs.r.to_numpy(float)
    i, j, r = np.r_[i, j], np.r_[j, i], np.where(np.isnan(r), -1.0, r)[np.r_[np.arange(len(r)), np.arange(len(r))]]
    o = np.argsort(i, kind="stable")
    j, r, first = j[o], r[o], np.searchsorted(i[o], np.arange(n + 1))
    mean, sd = genes["mean"].to_numpy(float), genes["sd"].to_numpy(float)

    def row(k: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = sd[k] * sd
            out = np.where(scale > 0, -(mean[k] * mean) / scale, -1.0)
        out[j[first[k] : first[k + 1]]] = r[first[k] : first[k + 1]]
        return out

    order = single_leaves(n, row)
    return pd.DataFrame({"gene": genes.gene.to_numpy()[order], "label": genes.label.to_numpy()[order], "inside": np.arange(n)})


def place_blocks(genes: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(gene, label, place): labels by average linkage of ``blocks`` (l1 <= l2, r), genes by single linkage inside a label.

    ``genes``: gene, label, mean, sd; ``pairs`` (label, g1, g2, r) inside a label. A pair that isn't given has the correlation
    that genes without a common cell have, -1 if they have no mean and deviation. A label is ordered in one task, which
    holds its genes and the pairs given, no matrix; only labels by labels are put in one task all together.
    """

    def labels(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _square(pdf, "l1", "l2", "r")
        order = [k for g in linkage_groups(m, "average") for k in g]
        return pd.DataFrame({"label": [names[k] for k in order], "at": np.arange(len(order))})

    turn = blocks.groupBy().applyInPandas(labels, "label string, at long")
    size = genes.groupBy("label").agg(F.count("*").alias("n")).join(turn, "label")
    start = size.select("label", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("start"))  # one row per label
    inside = genes.groupBy("label").cogroup(pairs.groupBy("label")).applyInPandas(_leaves_of_block, "gene string, label string, inside long")
    return inside.join(start, "label").select("gene", "label", (F.col("start") + F.col("inside")).cast("int").alias("place"))


def block_order(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, label, place): groups by average linkage of their mean correlations, genes by single linkage inside a group.

    ``pairs`` (g1, g2, r), ``groups`` (gene, label); genes without label or without any pair aren't placed; a missing or null
    correlation counts as -1.
    """
    side = lambda k: groups.select(F.col("gene").alias(f"g{k}"), F.col("label").alias(f"l{k}"))
    named = pairs.select("g1", "g2", F.coalesce(F.col("r").cast("double"), F.lit(-1.0)).alias("r")).join(side(1).where("l1 IS NOT NULL"), "g1").join(side(2).where("l2 IS NOT NULL"), "g2")
    genes = named.select(F.col("g1").alias("gene"), F.col("l1").alias("label")).union(named.select("g2", "l2")).distinct()
    size = genes.groupBy("label").agg(F.count("*").alias("n"))
    of = lambda k: size.select(F.col("label").alias(f"l{k}"), F.col("n").alias(f"n{k}"))
    met = named.groupBy(F.least("l1", "l2").alias("l1"), F.greatest("l1", "l2").alias("l2")).agg(F.sum(F.col("r") + 1).alias("above"))
    blocks = of(1).join(of(2), F.col("l1") <= F.col("l2")).join(met, ["l1", "l2"], "left")  # labels by labels
    blocks = blocks.select("l1", "l2", (F.coalesce("above", F.lit(0.0)) / (F.col("n1") * F.col("n2")) - 1).alias("r"))
    none = F.lit(None).cast("double")
    return place_blocks(genes.withColumns({"mean": none, "sd": none}), named.where("l1 = l2").select(F.col("l1").alias("label"), "g1", "g2", "r"), blocks)


def modules(pairs: DataFrame, least: float, min_size: int = 3, value: str = "z") -> DataFrame:
    """(gene, module): average linkage down to similarity ``least``; modules by falling size, -1 for genes in smaller groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _square(pdf, "g1", "g2", value)
        found = sorted(linkage_groups(m, "average", least), key=lambda g: (-len(g), min(g)))
        rows = [(names[i], k if len(g) >= min_size else -1) for k, g in enumerate(found) for i in g]
        return pd.DataFrame(rows, columns=["gene", "module"])

    return pairs.select("g1", "g2", F.col(value).cast("double").alias(value)).groupBy().applyInPandas(run, "gene string, module int")
