"""Occurrences and records of every distinct term, with a mark on those too rare or too common to be useful.

Method: vertical layout. A term owns one compressed bitmap of record numbers, kept as the non-empty 64-bit words of that
bitmap, (term, word number) -> bits. Bitmaps of parts merge by union (a bitwise or, combined before the shuffle) and the
document frequency is their cardinality. The parallel counter of occurrences is a bitmap over occurrence keys, so that a
delivery that came twice counts once. Records are numbered once by a written dictionary, so the numbers are dense and
survive lost executors.

Defined results: a null or blank value is no term; a null occurrence key is no occurrence (its record still counts); a
record whose key has a null part, or that ``record_ok`` refuses, is no record, but its occurrences count; an empty table
gives no rows; further columns don't matter. Terms are folded by :func:`cellwright.functions.text.fold`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.text import fold_udf
from cellwright.runtime import cut


def _words(df: DataFrame, number: str) -> DataFrame:
    """The bitmaps of ``term`` over ``number``, as their non-empty words."""
    bit = F.expr(f"shiftleft(1L, cast({number} & 63 AS int))")
    return df.groupBy("term", F.shiftright(number, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _cardinality(words: DataFrame, name: str) -> DataFrame:
    return words.groupBy("term").agg(F.sum(F.bit_count("bits")).cast("long").alias(name))


def term_frequencies(
    df: DataFrame,
    value: str,
    occurrence: str,
    record: list[str] | None = None,
    record_ok: Column | None = None,
    *,
    rare_below: int = 5,
    common_above: float = 0.5,
) -> DataFrame:
    """(term, occurrences, records, all_records, rare, common) of ``value``.

    ``occurrence`` is the bigint key of a row; ``record`` the columns that name the record it belongs to. Without
    ``record`` each occurrence with a term is a record. ``rare``: fewer than ``rare_below`` occurrences; ``common``: in
    more than the share ``common_above`` of all records.
    """
    keys = record or []
    base = df.select(
        F.col(f"`{value}`").alias("raw"),
        F.col(f"`{occurrence}`").cast("long").alias("occ"),
        *(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)),
        F.coalesce(record_ok if record_ok is not None else F.lit(True), F.lit(False)).alias("ok"),
    )
    terms = base.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.lit(1).alias("n"))
    terms = cut(terms.select("raw", fold_udf("raw").alias("term"))).where("term <> ''")
    told = base.join(terms, "raw")
    occ = cut(_words(told.where("occ IS NOT NULL"), "occ"))
    counted = _cardinality(occ, "occurrences")
    if not keys:
        total = occ.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("all_records"))
        out = counted.withColumn("records", F.col("occurrences"))
    else:
        ks = [f"k{i}" for i in range(len(keys))]
        held = base.where(F.col("ok")).dropna(subset=ks)
        dictionary = cut(held.groupBy(*ks).agg(F.lit(1).alias("n")).select(*ks, F.monotonically_increasing_id().alias("rec")))
        total = dictionary.agg(F.count("*").alias("all_records"))
        pairs = held.where(F.col("raw").isNotNull()).groupBy("raw", *ks).agg(F.lit(1).alias("n"))
        words = _words(pairs.join(terms, "raw").join(dictionary, ks), "rec")
        out = counted.join(_cardinality(words, "records"), "term", "full")
    out = out.crossJoin(F.broadcast(total))  # one row
    n, r = F.coalesce("occurrences", F.lit(0)), F.coalesce("records", F.lit(0))
    return out.select(
        "term",
        n.cast("long").alias("occurrences"),
        r.cast("long").alias("records"),
        "all_records",
        (n < rare_below).alias("rare"),
        (r > F.col("all_records") * common_above).alias("common"),
    )
