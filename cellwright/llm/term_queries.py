"""Problem 2 over feature names (records: cells) and predicted labels (records: cells of an export)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.term_frequency import term_frequencies
from cellwright.runtime import table


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term of both fields with its occurrences, records and marks."""
    real_cell = ~F.col("cell_id").isin("", "UNASSIGNED")
    genes = term_frequencies(
        table(spark, sf_dir, "labeled_transcripts"), "feature_name", "transcript_id", ["dataset", "cell_id"], real_cell, common_above=0.5
    )
    labels = term_frequencies(table(spark, sf_dir, "h5ads"), "celltypist_label", "obs_id", common_above=0.25)
    named = [d.select(F.lit(n).alias("field"), *d.columns) for n, d in (("feature_name", genes), ("celltypist_label", labels))]
    return reduce(DataFrame.unionByName, named).drop("all_records")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return p2_terms(spark, sf_dir).select("field", "term", F.explode(marks).alias("mark"))


_FOLD = r"trim(regexp_replace(nfc_normalize(lower({0})), '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'))"
_TERMS = f"""
WITH tx AS (SELECT DISTINCT transcript_id, dataset, cell_id, {_FOLD.format("feature_name")} AS term FROM labeled_transcripts),
cells AS (SELECT count(*) AS n FROM (SELECT DISTINCT dataset, cell_id FROM tx WHERE cell_id NOT IN ('', 'UNASSIGNED'))),
g AS (SELECT term, count(DISTINCT transcript_id) AS occ FROM tx WHERE term <> '' GROUP BY term),
r AS (SELECT term, count(*) AS rec FROM (SELECT DISTINCT term, dataset, cell_id FROM tx
      WHERE term <> '' AND cell_id NOT IN ('', 'UNASSIGNED')) GROUP BY term),
ob AS (SELECT DISTINCT obs_id, {_FOLD.format("celltypist_label")} AS term FROM h5ads),
ol AS (SELECT * FROM ob WHERE term <> ''),
lab AS (SELECT term, count(DISTINCT obs_id) AS occ FROM ol GROUP BY term),
t AS (SELECT 'feature_name' AS field, g.term, occ AS occurrences, coalesce(rec, 0) AS records, occ < 5 AS rare,
             coalesce(rec, 0) > cells.n * 0.5 AS common FROM g LEFT JOIN r ON g.term = r.term, cells
      UNION ALL
      SELECT 'celltypist_label', term, occ, occ, occ < 5, occ > (SELECT count(DISTINCT obs_id) FROM ol) * 0.25 FROM lab)
"""
QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms}
ORACLES = {
    "p2_terms": _TERMS + "SELECT * FROM t",
    "p2_found": _TERMS
    + "SELECT field, term, 'rare' AS mark FROM t WHERE rare UNION ALL SELECT field, term, 'common' FROM t WHERE common",
}
