"""Segmentation agreement of the vendor's cells (a) with the other method's cells (b)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import segmentation as seg
from cellwright.plans.base import TX, Book, tx
from cellwright.runtime import cut

book = Book()
_SIDES = f"""WITH {TX},
na AS (SELECT a, count(*) AS na, avg(CAST(pos AS DOUBLE)) AS p FROM tx WHERE a IS NOT NULL GROUP BY a),
nb AS (SELECT b, count(*) AS nb FROM tx WHERE b IS NOT NULL GROUP BY b),
ab AS (SELECT a, b, count(*) AS n FROM tx WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
best AS (SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM ab) WHERE r = 1),
j AS (SELECT best.a AS cell, CAST(n AS DOUBLE) AS n, na, nb FROM best JOIN na ON na.a = best.a AND p > 0.33 JOIN nb ON nb.b = best.b)
"""


def _agreed(metric):
    def query(spark, sf_dir):
        return seg.agreement(tx(spark, sf_dir, "a", "b", "pos")).where(F.col(metric).isNotNull()).select("cell", F.col(metric).alias("value"))

    return query


book.add("seg_jaccard", _SIDES + "SELECT cell, n / (na + nb - n) AS value FROM j WHERE na >= 10 AND nb >= 10")(_agreed("jaccard"))
book.add("seg_purity", _SIDES + "SELECT cell, n / na AS value FROM j WHERE na >= 10")(_agreed("purity"))
book.add("seg_recall", _SIDES + "SELECT cell, n / nb AS value FROM j WHERE nb >= 5")(_agreed("recall"))
book.add("seg_contamination", _SIDES + "SELECT a AS cell, p AS value FROM na WHERE p > 0.33 AND na > 5")(lambda s, d: seg.contamination(tx(s, d, "a", "pos")))
book.add("seg_num_transcripts", _SIDES + "SELECT a AS cell, na AS value FROM na WHERE p > 0.33")(lambda s, d: seg.num_transcripts(tx(s, d, "a", "pos")))
book.add("seg_num_cells", f"WITH {TX} SELECT count(DISTINCT a) AS vendor, count(DISTINCT b) AS other FROM tx")(
    lambda s, d: tx(s, d, "a", "b").agg(F.count_distinct("a").alias("vendor"), F.count_distinct("b").alias("other"))
)
book.add("agg_idxmax", _SIDES + "SELECT a, b, n FROM best")(lambda s, d: seg.best_partner(tx(s, d, "a", "b")))
_OVER = """SELECT p.b AS cell, CAST(sum(CASE WHEN CAST(p.n AS DOUBLE) / t.na > 0.25 AND t.na > 5 THEN 1 ELSE 0 END) AS BIGINT) AS value
FROM (SELECT a, b, count(*) AS n FROM tx WHERE a IS NOT NULL AND b IS NOT NULL AND {0} GROUP BY a, b) p
JOIN (SELECT a, count(*) AS na FROM tx WHERE a IS NOT NULL AND {1} GROUP BY a) t ON t.a = p.a GROUP BY p.b"""
book.add("seg_overlap", f"WITH {TX} " + _OVER.format("pos = 1", "true"))(lambda s, d: seg.overlap(tx(s, d, "a", "b", "pos")))
book.add("seg_overlap_score", f"WITH {TX} " + _OVER.format("score IS NOT NULL", "score IS NOT NULL"))(lambda s, d: seg.overlap(tx(s, d, "a", "b", "pos", "score"), score="score"))
_ALL = f"""WITH {TX}, w AS (SELECT id, a AS t, CASE WHEN score < 0.5 THEN NULL ELSE b END AS m, pos, score FROM tx),
nm AS (SELECT m, count(*) AS nm, avg(CAST(pos AS DOUBLE)) AS p FROM w WHERE m IS NOT NULL GROUP BY m),
nt AS (SELECT t, count(*) AS nt, avg(CAST(pos AS DOUBLE)) AS p FROM w WHERE t IS NOT NULL GROUP BY t),
mt AS (SELECT m, t, count(*) AS n FROM w WHERE m IS NOT NULL AND t IS NOT NULL GROUP BY m, t),
best AS (SELECT m, t, n FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, t) AS r FROM mt) WHERE r = 1),
j AS (SELECT best.m AS cell, CAST(n AS DOUBLE) AS n, nm, nt FROM best JOIN nm ON nm.m = best.m AND p > 0.33 JOIN nt ON nt.t = best.t),
o AS (SELECT p.t AS cell, CAST(sum(CASE WHEN CAST(p.n AS DOUBLE) / q.n > 0.25 AND q.n > 5 THEN 1 ELSE 0 END) AS DOUBLE) AS value
  FROM (SELECT m, t, count(*) AS n FROM w WHERE m IS NOT NULL AND t IS NOT NULL AND score IS NOT NULL GROUP BY m, t) p
  JOIN (SELECT m, count(*) AS n FROM w WHERE m IS NOT NULL AND score IS NOT NULL GROUP BY m) q ON q.m = p.m GROUP BY p.t)
SELECT 'num_transcripts' AS metric, 'a' AS segmentation, t AS cell, CAST(nt AS DOUBLE) AS value FROM nt WHERE p > 0.33
UNION ALL SELECT unnest(['jaccard', 'purity', 'recall', 'overlap', 'contamination']), 'a', NULL, 0.0 UNION ALL SELECT 'num_transcripts', 'b', m, nm FROM nm WHERE p > 0.33 UNION ALL SELECT 'contamination', 'b', m, p FROM nm WHERE p > 0.33 AND nm > 5
UNION ALL SELECT 'overlap', 'b', cell, value FROM o UNION ALL SELECT 'jaccard', 'b', cell, n / (nm + nt - n) FROM j WHERE nm >= 10 AND nt >= 10
UNION ALL SELECT 'purity', 'b', cell, n / nm FROM j WHERE nm >= 10 UNION ALL SELECT 'recall', 'b', cell, n / nt FROM j WHERE nt >= 5"""
book.add("seg_metrics_all", _ALL)(lambda s, d: seg.all_metrics(cut(tx(s, d, "a", "b", "pos", "score")), {"b": "score"}, "a"))
