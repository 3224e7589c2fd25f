"""Mixing sources to target shares of the total size, each record used at most a capped number of times.

Method: temperature mixing. The sources' own token shares n are raised to an exponent e and multiplied by the target shares t
raised to 1 - e, then normalised: e = 0 keeps the targets, e = 1 the sources as they are, and with level targets it is plain
temperature mixing. A budget that the targets can't fill within the repetition limits is met by bisecting for the
smallest e that fills it (the nearer to 1, the more equal the number of uses). ``entropy`` asks for plain temperature
mixing at the e whose weights have that entropy, found by bisection too. Without a budget the mix is the largest one whose
shares are exactly the targets.

The weights are realised as budgeted block permutations: a source's records are permuted by a hash, and its budget takes whole
passes over the permutation and then a part of one more. That part is found block by block: sums over 64 blocks of hash
values tell in which block the budget ends, the same is done inside that block until at most ``BLOCK`` records are left,
and these are taken in order as long as they fit, passing over those that don't, the last where that comes nearer.

Defined results: sources are matched after folding case, white space, '-' and '_'; records of unlisted or missing sources
and records without size are used 0 times and reported; a target source without records gets the weight 0 and the others
share it; repetition limits below 1 or null mean never; ids that come twice are records each; an empty table gives a report
of zeros.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.runtime import cut

#: Records in the block whose end is settled record by record; bits of the hash that each narrowing uses, and how many it has.
BLOCK, DIGIT, DIGITS = 4096, 6, 12


def source_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s _\-]+", "_"), r"^_+|_+$", ""))


def weights(natural: dict, target: dict, exponent: float) -> dict:
    """natural ** exponent * target ** (1 - exponent), normalised; sources that lack either get 0."""
    log = {s: exponent * math.log(natural[s]) + (1 - exponent) * math.log(target[s]) for s in target if target[s] > 0 and natural.get(s, 0) > 0}
    top = max(log.values(), default=0.0)
    raw = {s: math.exp(v - top) for s, v in log.items()}
    total = sum(raw.values())
    return {s: raw.get(s, 0.0) / total if total else 0.0 for s in target}


def entropy(w: dict) -> float:
    return -sum(p * math.log(p) for p in w.values() if p > 0)


def _bisect(good, low: float, high: float) -> float:
    """The smallest value on which ``good`` holds, known to hold at ``high`` and to stay true once it is."""
    while high - low > 1e-12 * max(1.0, high):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def solve(shares: dict, tokens: dict, most: dict, budget: float | None = None, target_entropy: float | None = None):
    """(weights, budget, exponent) of the mix."""
    room = {s: tokens.get(s, 0) * max(0, most.get(s) or 0) for s in shares}
    target = {s: p for s, p in shares.items() if p > 0 and room[s] > 0}
    if not target:
        return {}, 0.0, 0.0
    have = sum(tokens[s] for s in target)
    natural = {s: tokens[s] / have for s in target}
    full = lambda w: min(room[s] / w[s] for s in w if w[s] > 0)
    exponent = 0.0
    if target_entropy is not None:
        target = dict.fromkeys(target, 1 / len(target))
        reached = lambda e: entropy(weights(natural, target, e)) <= target_entropy
        high = 1.0
        while not reached(high) and high < 1e6:
            high *= 2
        exponent = _bisect(reached, 0.0, high) if reached(high) and not reached(0.0) else 0.0
    w = weights(natural, target, exponent)
    if budget is None:
        return w, full(w), exponent
    # a last tenth of a part in a billion is rounding, not room
    fills = lambda e: full(weights(natural, target, e)) >= budget * (1 - 1e-10)
    if not fills(exponent):
        low, exponent = exponent, max(1.0, exponent)
        if fills(exponent):
            exponent = _bisect(fills, low, exponent)
        w = weights(natural, target, exponent)
    return w, min(float(budget), full(w)), exponent


def _fit(rest: float, sizes) -> list[bool]:
    """Records taken in order as long as they fit into ``rest``; then the one that ends nearest, if that is nearer."""
    taken, room = [], rest
    for s in sizes:
        taken.append(s <= room)
        room -= s if taken[-1] else 0
    over = min(((abs(s - room), i) for i, s in enumerate(sizes) if not taken[i]), default=(math.inf, -1))
    if over[0] < room:
        taken[over[1]] = True
    return taken


def _last_pass(rows: DataFrame, rest: dict, records: dict) -> tuple[dict, dict]:
    """Per source: the digits of the block in which ``rest`` ends, and what of ``rest`` is left for that block."""
    at, left = {s: () for s, r in rest.items() if r > 0}, dict(rest)
    spark, live = rows.sparkSession, {s for s in at if records[s] > BLOCK}
    for level in range(DIGITS):
        if not live:
            break
        here = spark.createDataFrame([(s, list(at[s])) for s in live], "source string, prefix array<int>")  # one row per source
        inside = rows.join(F.broadcast(here), "source").where((F.lit(level) == 0) | (F.slice("digits", 1, max(level, 1)) == F.col("prefix")))
        block = inside.groupBy("source", F.element_at("digits", level + 1).alias("d")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
        done = F.sum("tokens").over(Window.partitionBy("source").orderBy("d"))  # at most 64 blocks of a source
        limit = F.create_map(*(F.lit(x) for s in live for x in (s, float(left[s]))))
        ends = block.withColumn("before", done - F.col("tokens")).where(F.col("before") <= limit[F.col("source")]).groupBy("source").agg(F.max(F.struct("d", "before", "n")).alias("e"))
        for r in ends.collect():
            at[r.source] += (r.e.d,)
            left[r.source] -= r.e.before
            if r.e.n <= BLOCK:
                live.discard(r.source)
    return at, left


def mix_sources(records: DataFrame, id_col: str, source: str, size: str, targets: DataFrame, *, budget: float | None = None, budget_share: float | None = None, target_entropy: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, uses) of all records, and the report per target source (and on all other records).

    ``targets``: source, target_share, max_repeats; one row per source, so few that they are held by the driver.
    ``budget_share`` gives the budget as a share of the size of all records of target sources.
    """
    spark = records.sparkSession
    want = targets.select("source", source_key(F.col("source")).alias("key"), F.col("target_share").cast("double").alias("share"), "max_repeats").dropna(subset=["key"])
    rows = records.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("said"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"))
    rows = rows.join(want.select("key", F.col("source").alias("source")), source_key(F.col("said")) == F.col("key"), "left").select("id", "source", "size")
    # half of the digits come from the id; copies of one id are told apart by the row itself
    h = (F.xxhash64("id", F.lit(seed)), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    digit = [F.shiftright(h[i // 6], DIGIT * (i % 6)).bitwiseAND((1 << DIGIT) - 1).cast("int") for i in range(DIGITS)]
    rows = cut(rows.withColumn("digits", F.array(*digit)))
    usable = rows.where("source IS NOT NULL AND size > 0")
    have = usable.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).collect()  # one row per target source
    tokens, n = {r.source: r.tokens for r in have}, {r.source: r.n for r in have}
    asked = want.collect()
    shares, most = {r.source: r.share or 0.0 for r in asked}, {r.source: r.max_repeats for r in asked}
    budget = budget_share * sum(tokens.values()) if budget_share is not None else budget
    w, total, exponent = solve(shares, tokens, most, budget, target_entropy)
    told = {}
    for s in shares:
        b = w.get(s, 0.0) * total
        passes = min(int(b // tokens[s] + 1e-9), most[s]) if tokens.get(s) and b > 0 else 0
        told[s] = (passes, b - passes * tokens.get(s, 0) if b > 0 and passes < most[s] else 0.0)
    at, left = _last_pass(usable, {s: r for s, (_, r) in told.items()}, n)
    few = spark.createDataFrame([(s, p, list(at[s]) if s in at else None, float(left.get(s, 0.0))) for s, (p, _) in told.items()], "source string, passes long, edge array<int>, rest double")
    out = rows.join(F.broadcast(few), "source", "left")  # one row per target source
    mine = F.when(F.size("edge") > 0, F.slice("digits", 1, F.greatest(F.size("edge"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("where", F.when(F.col("edge").isNull() | (F.col("size") <= 0), 1).when(mine == F.col("edge"), 0).when(mine < F.col("edge"), -1).otherwise(1))

    def end(pdf: pd.DataFrame) -> pd.DataFrame:  # at most BLOCK records of a source
        pdf = pdf.assign(order=pdf["digits"].map(tuple)).sort_values(["order", "id"])
        return pdf.assign(extra=[int(t) for t in _fit(pdf["rest"].iloc[0], pdf["size"].tolist())])[["id", "source", "size", "passes", "extra"]]

    kind = dict(rows.dtypes)["id"]
    edge = out.where("where = 0").select("id", "source", "size", "passes", "digits", "rest").groupBy("source").applyInPandas(end, f"id {kind}, source string, size long, passes long, extra long")
    rest = out.where("where <> 0").select("id", "source", "size", "passes", (F.col("where") < 0).cast("long").alias("extra"))
    uses = F.when(F.col("size") > 0, F.coalesce(F.col("passes"), F.lit(0)) + F.col("extra")).otherwise(0).cast("long")
    every = cut(rest.unionByName(edge).select("id", "source", "size", uses.alias("uses")))
    got = every.groupBy("source").agg(F.count("*").alias("records"), F.sum("size").alias("tokens"), F.sum(F.col("size") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"), F.max("size").alias("largest"))
    allt = every.agg(F.sum("size").alias("at"), F.sum(F.col("size") * F.col("uses")).alias("am"))
    weight = spark.createDataFrame([(s, float(w.get(s, 0.0)), float(w.get(s, 0.0) * total)) for s in shares], "source string, weight double, budget double")
    report = got.join(want.select("source", "share", "max_repeats"), "source", "full").join(F.broadcast(weight), "source", "left").crossJoin(F.broadcast(allt))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    report = report.select(
        "source", F.col("share").alias("target_share"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "max_repeats", zero("records").alias("records"), zero("tokens").alias("tokens"),
        F.coalesce(F.try_divide("tokens", "at"), F.lit(0.0)).alias("natural_share"), zero("largest").alias("largest"), F.coalesce("budget", F.lit(0.0)).alias("budget"), zero("mixed_tokens").alias("mixed_tokens"),
        F.coalesce(F.try_divide("mixed_tokens", "am"), F.lit(0.0)).alias("reached_share"), zero("most_uses").alias("most_uses"), F.lit(float(exponent)).alias("exponent"),
    )
    return every, report
