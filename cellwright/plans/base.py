"""What the queries read: cleaned views of the given tables, and the same views in SQL for the oracles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import markers as mk
from cellwright.runtime import cut, table, usable


#: White space in both engines' patterns (\\s alone is ASCII only, and one engine's trim isn't).
SPACE, SPACE_SQL = r"[\s\u00a0\u3000]+", r"[\s\x{a0}\x{3000}]+"


def gene(c: str = "feature_name"):
    """Feature names in one spelling: upper case, white space removed; blank is null."""
    return F.nullif(F.upper(F.regexp_replace(c, SPACE, "")), F.lit(""))


GENE_SQL = "nullif(upper(regexp_replace({0}, '" + SPACE_SQL.replace("{", "{{").replace("}", "}}") + "', '', 'g')), '')"


def tx(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per molecule: id, dataset, a (vendor's cell), b (the other method's cell), score, pos, gene, qv, x, y; or id and ``columns``.

    A molecule that came twice has the same content, so rows are made distinct over the columns asked for: filters
    on them reach the scan, and only they are shuffled.
    """
    c, seg = F.col, F.col("`segger_cell_id_cxg_k=20`")
    raw = table(spark, sf_dir, "labeled_transcripts").where("transcript_id IS NOT NULL")
    num = lambda x: F.when(~F.isnan(x), x)
    made = {
        "dataset": c("dataset"), "a": F.when(~c("cell_id").isin("", "UNASSIGNED"), F.concat("dataset", F.lit("/"), "cell_id")),
        "b": F.when(seg.isNotNull() & ~F.isnan(seg), F.concat("dataset", F.lit("#"), seg.cast("bigint").cast("string"))), "score": num(c("`score_cxg_k=20`")),
        "pos": c("overlaps_nucleus"), "gene": gene(), "qv": num(c("qv")),
        "x": F.when(usable(c("x_location")), c("x_location")), "y": F.when(usable(c("y_location")), c("y_location")),
    }
    return raw.select(c("transcript_id").alias("id"), *(made[n].alias(n) for n in columns or made)).distinct()


_N = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_C = "CASE WHEN NOT isnan({0}) AND {0} >= 0 AND {0} < 'inf'::DOUBLE THEN {0} END"
TX = f"""tx AS (SELECT DISTINCT ON (transcript_id) transcript_id AS id, dataset,
  CASE WHEN cell_id NOT IN ('', 'UNASSIGNED') THEN dataset || '/' || cell_id END AS a,
  CASE WHEN NOT isnan("segger_cell_id_cxg_k=20") THEN dataset || '#' || CAST(CAST("segger_cell_id_cxg_k=20" AS BIGINT) AS VARCHAR) END AS b,
  {_N.format('"score_cxg_k=20"')} AS score, overlaps_nucleus AS pos, {GENE_SQL.format("feature_name")} AS gene, {_N.format("qv")} AS qv,
  {_C.format("x_location")} AS x, {_C.format("y_location")} AS y
  FROM labeled_transcripts WHERE transcript_id IS NOT NULL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exported cell: id, dataset, object, vendor_id, n_counts, cluster, label, prob, entropy, l1, l2, x, y."""
    v, ok = F.col("X_spatial"), F.coalesce((F.size("X_spatial") == 2) & F.forall("X_spatial", lambda e: (e >= 0) & (e < float("inf"))), F.lit(False))
    at = lambda i: F.when(ok, F.try_element_at(v, F.lit(i)))
    label = F.nullif(F.lower(F.trim(F.regexp_replace("celltypist_label", SPACE, " "))), F.lit(""))
    return table(spark, sf_dir, "h5ads").where("obs_id IS NOT NULL").select(
        F.col("obs_id").alias("id"), "dataset", F.col("h5ad_name").alias("object"), F.concat("dataset", F.lit("/"), "`10x_id`").alias("vendor_id"), "n_counts",
        F.col("phenograph_cluster").alias("cluster"), label.alias("label"), F.col("celltypist_probability").alias("prob"), F.col("celltypist_entropy").alias("entropy"),
        F.col("cell_type_level_1").alias("l1"), F.col("cell_type_level_2").alias("l2"), at(1).alias("x"), at(2).alias("y"),
    ).dropDuplicates(["id"])


_OK = "len(X_spatial) = 2 AND NOT isnan(X_spatial[1]) AND NOT isnan(X_spatial[2]) AND X_spatial[1] >= 0 AND X_spatial[1] < 'inf'::DOUBLE AND X_spatial[2] >= 0 AND X_spatial[2] < 'inf'::DOUBLE"
CELLS = f"""cells AS (SELECT DISTINCT ON (obs_id) obs_id AS id, dataset, h5ad_name AS object, dataset || '/' || "10x_id" AS vendor_id, n_counts,
  phenograph_cluster AS cluster, nullif(lower(trim(regexp_replace(celltypist_label, '{SPACE_SQL}', ' ', 'g'))), '') AS label, celltypist_probability AS prob,
  celltypist_entropy AS entropy, cell_type_level_1 AS l1, cell_type_level_2 AS l2,
  CASE WHEN {_OK} THEN X_spatial[1] END AS x, CASE WHEN {_OK} THEN X_spatial[2] END AS y FROM h5ads WHERE obs_id IS NOT NULL)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count matrix in long form: (cell, gene, n) over the vendor's assignment."""
    return tx(spark, sf_dir, "a", "gene").where("a IS NOT NULL AND gene IS NOT NULL").groupBy(F.col("a").alias("cell"), "gene").agg(F.count("*").alias("n"))


COUNTS = TX + ", m AS (SELECT a AS cell, gene, count(*) AS n FROM tx WHERE a IS NOT NULL AND gene IS NOT NULL GROUP BY ALL)"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, type): level-1 family of the vendor's own object; unlabelled cells are left out."""
    own = cells(spark, sf_dir).where("object = '10x_cell' AND l1 IS NOT NULL AND vendor_id IS NOT NULL")
    return own.groupBy(F.col("vendor_id").alias("cell")).agg(F.min("l1").alias("type"))


TYPED = CELLS + ", typed AS (SELECT vendor_id AS cell, min(l1) AS type FROM cells WHERE object = '10x_cell' AND l1 IS NOT NULL AND vendor_id IS NOT NULL GROUP BY 1)"


class Study:
    """The count matrix, the typed cells and what markers are found from, each computed and written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._of = (spark, sf_dir)

    @cached_property
    def m(self) -> DataFrame:
        return cut(counts(*self._of))

    @cached_property
    def typed(self) -> DataFrame:
        return cut(typed(*self._of))

    @cached_property
    def tg(self) -> DataFrame:
        return cut(mk.type_gene(self.m, self.typed))

    @cached_property
    def markers(self) -> DataFrame:
        return cut(mk.find_markers(self.tg))

    @cached_property
    def pairs(self) -> DataFrame:
        return cut(mk.exclusive_pairs(mk.exclusive_genes(self.tg, self.markers)))


class Book:
    """A register of queries and of the SQL that checks them."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep
