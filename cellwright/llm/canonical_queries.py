"""Problem 3: labels and groups typed into marker_annotations, mapped to the entries of cell_types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.canonical_map import map_to_canonical
from cellwright.runtime import table


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in ("label", "group")))
    rows = table(spark, sf_dir, "marker_annotations").where("marker_id IS NOT NULL").select("marker_id", F.explode(typed).alias("t"))
    rows = rows.select("marker_id", "t.field", "t.value")
    return map_to_canonical(rows, ["marker_id", "field"], "value", table(spark, sf_dir, "cell_types"), "cell_type_id", "name", "aliases")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("marker_id", "field", F.col("entry").alias("cell_type_id")).distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on values that mean no entry: each with its field and number of records."""
    return _mapped(spark, sf_dir).where("entry = -1").groupBy("field", "value").agg(F.count("*").alias("records"))


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
ORACLES: dict[str, str] = {}
