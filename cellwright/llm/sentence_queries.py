"""Problem 8: every document as its sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwright.llm.sentence_split import sentences
from cellwright.runtime import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"p8_found": p8_found}
ORACLES: dict[str, str] = {}
