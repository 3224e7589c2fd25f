"""Problems 6 and 7 over documents, measured in tokens of a public tokenizer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.container_fill import fill_containers, pack
from cellwright.llm.source_mix import mix_sources
from cellwright.llm.tokens import token_count
from cellwright.runtime import cut, parts, spread, table

CAPACITY = 2048


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), parts(spark), "doc_id")
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of a document longer than a container, with the container that holds it."""
    return fill_containers(sized(spark, sf_dir), "doc_id", "tokens", CAPACITY).withColumnRenamed("id", "doc_id")


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, the bound on their number, and the share of tokens that the rounded program placed."""
    packed, made = pack(sized(spark, sf_dir), "doc_id", "tokens", CAPACITY)
    held = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("length").alias("used"))
    n, used = F.count("*"), F.coalesce(F.sum("used"), F.lit(0))
    return held.agg(
        n.alias("containers"), used.cast("long").alias("tokens"), F.max("used").alias("fullest"), F.try_divide(used, n * CAPACITY).alias("share_used"),
        F.lit(math.ceil(made.bound - 1e-6)).alias("least"), F.try_divide(F.lit(made.by_configuration), used).alias("share_by_configuration"),
    )


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must keep to: documents, and the numbers of overfull containers, of documents not held token by token, and of needless cuts."""
    docs = cut(sized(spark, sf_dir).select("doc_id", "tokens"))
    packed = cut(fill_containers(docs, "doc_id", "tokens", CAPACITY))
    full = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("length").alias("used"))
    per = packed.groupBy(F.col("id").alias("doc_id")).agg(F.sum("length").alias("held"), F.sum(F.col("start") - F.col("piece") * CAPACITY).alias("shift"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("numbers"))
    both = docs.join(per, "doc_id", "left")
    whole = (F.col("held") == F.col("tokens")) & (F.col("shift") == 0) & (F.col("pieces") == F.col("numbers"))
    fits = F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / CAPACITY))
    kept = both.agg(F.count("*").alias("documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("broken"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("needless_cuts"))
    return kept.crossJoin(F.broadcast(full.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"))))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares wanted and reached, per source."""
    return mix_sources(sized(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "source_targets"))[1]


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of times that the mix uses it."""
    return mix_sources(sized(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "source_targets"))[0].withColumnRenamed("id", "doc_id")


def p7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the corpus itself: the targets would repeat small sources too often, so the exponent gives way."""
    return mix_sources(sized(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "source_targets"), budget_share=1.0)[1]


def p7_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain temperature mixing of the sources' token shares to nine tenths of the highest entropy that nine sources can have."""
    return mix_sources(sized(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "source_targets"), target_entropy=0.9 * math.log(9))[1]


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source of the three mixes: whether no record is used too often, and whether it holds its budget to half a record."""
    every = None
    for name, mix in (("targets", p7_mix), ("budget", p7_budget), ("entropy", p7_entropy)):
        r = mix(spark, sf_dir).where("target_share IS NOT NULL")
        near = F.abs(F.col("mixed_tokens") - F.col("budget")) <= F.col("largest") / 2 + 1
        r = r.select(F.lit(name).alias("mix"), "source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_limit"), near.alias("as_weighted"))
        every = r if every is None else every.unionByName(r)
    return every


QUERIES = {"p6_packing": p6_packing, "p6_use": p6_use, "p6_kept": p6_kept, "p7_mix": p7_mix, "p7_records": p7_records, "p7_budget": p7_budget, "p7_entropy": p7_entropy, "p7_kept": p7_kept}
ORACLES = {
    "p6_kept": "SELECT count(*) AS documents, 0::BIGINT AS broken, 0::BIGINT AS needless_cuts, 0::BIGINT AS overfull FROM documents",
    "p7_kept": "SELECT mix, source, true AS within_limit, true AS as_weighted FROM source_targets, (VALUES ('targets'), ('budget'), ('entropy')) v(mix)",
}
