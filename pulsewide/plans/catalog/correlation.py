"""Correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewide.operators import correlate as K
from pulsewide.plans import views as V
from pulsewide.plans.catalog.registry import FEATURES, WIDE, query, r, rounded, stacked
from pulsewide.session import materialise

_NUM = V.NUMERIC_FEATURES

_PAIRS = f"""{FEATURES}, cells AS ({stacked('order_features', _NUM, keep='row_id')}),
pair_values AS (
  SELECT a.col AS col_a, b.col AS col_b, a.pos AS pos_a, b.pos AS pos_b, a.v AS va, b.v AS vb
  FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.pos < b.pos)"""

_PEARSON = _PAIRS + """,
matrix AS (
  SELECT col_a, col_b, any_value(pos_a) AS pos_a, any_value(pos_b) AS pos_b, count(*) AS n,
         CASE WHEN min(va) < max(va) AND min(vb) < max(vb) THEN corr(va, vb) END AS rho
  FROM pair_values GROUP BY col_a, col_b)"""

_RANKED = """
ranked AS (
  SELECT col_a, col_b, pos_a, pos_b,
         rank() OVER (PARTITION BY pos_a, pos_b ORDER BY va)
           + (count(*) OVER (PARTITION BY pos_a, pos_b, va) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY pos_a, pos_b ORDER BY vb)
           + (count(*) OVER (PARTITION BY pos_a, pos_b, vb) - 1) / 2.0 AS rb
  FROM pair_values),
matrix AS (
  SELECT col_a, col_b, any_value(pos_a) AS pos_a, any_value(pos_b) AS pos_b, count(*) AS n,
         CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END AS rho
  FROM ranked GROUP BY col_a, col_b)"""
_SPEARMAN = _PAIRS + "," + _RANKED


@query("c1_pearson", f"WITH {_PEARSON} SELECT col_a, col_b, {r('rho', 'rho')}, n FROM matrix")
def c1_pearson(spark, sf_dir):
    return rounded(K.pearson(V.features(spark, sf_dir), _NUM), "rho")


@query("c2_spearman", f"WITH {_SPEARMAN} SELECT col_a, col_b, {r('rho', 'rho')}, n FROM matrix")
def c2_spearman(spark, sf_dir):
    return rounded(K.spearman(V.features(spark, sf_dir), _NUM, ["row_id"]), "rho")


@query("c2_spearman_by_join", f"WITH {_SPEARMAN} SELECT col_a, col_b, {r('rho', 'rho')}, n FROM matrix")
def c2_spearman_by_join(spark, sf_dir):
    """The same matrix with every value joined by key, none by broadcast."""
    return rounded(K.spearman(V.features(spark, sf_dir), _NUM, ["row_id"], hot_share=1.0), "rho")


_OUTLIER = f"""{FEATURES},
spiked AS (SELECT row_id, qty_sum AS x, CASE WHEN row_id % 50 = 1 THEN CAST(1e12 AS DOUBLE) ELSE total_price END AS y,
                  CASE WHEN row_id % 50 <> 1 THEN price_sum END AS z FROM order_features),
cells AS ({stacked('spiked', ['x', 'y', 'z'], keep='row_id')}),
pair_values AS (
  SELECT a.col AS col_a, b.col AS col_b, a.v AS va, b.v AS vb
  FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.pos < b.pos)"""


@query("c1_pearson_outlier", f"""
WITH {_OUTLIER}
SELECT col_a, col_b, {r('CASE WHEN min(va) < max(va) AND min(vb) < max(vb) THEN corr(va, vb) END', 'rho')}, count(*) AS n
FROM pair_values GROUP BY col_a, col_b""")
def c1_pearson_outlier(spark, sf_dir):
    """Huge values outside the rows that a pair shares do not touch the pair."""
    spike = F.col("row_id") % 50 == 1
    rows = V.features(spark, sf_dir).select(
        F.col("qty_sum").alias("x"), F.when(spike, F.lit(1e12)).otherwise(F.col("total_price")).alias("y"),
        F.when(~spike, F.col("price_sum")).alias("z"),
    )
    return rounded(K.pearson(rows, ["x", "y", "z"]), "rho")


@query("c4_pairs_pearson", f"""
WITH {_PEARSON} SELECT col_a, col_b, {r('rho', 'rho')}, n FROM matrix WHERE abs(rho) > 0.85""")
def c4_pairs_pearson(spark, sf_dir):
    return rounded(K.strong_pairs(K.pearson(V.features(spark, sf_dir), _NUM)), "rho")


@query("c3_candidates", f"""
WITH {FEATURES}, cells AS ({stacked('order_features', _NUM)}), total AS (SELECT count(*) AS n FROM order_features)
SELECT col AS "column" FROM cells, total GROUP BY col, total.n
HAVING 100.0 - count(*) * 100.0 / total.n <= 80 AND min(v) < max(v)""")
def c3_candidates(spark, sf_dir):
    kept = K.matrix_columns(V.features(spark, sf_dir), _NUM)
    return spark.createDataFrame([(c,) for c in kept], "column string")


@query("c4_pairs", f"""
WITH {_SPEARMAN} SELECT col_a, col_b, {r('rho', 'rho')}, n FROM matrix WHERE abs(rho) > 0.85""")
def c4_pairs(spark, sf_dir):
    return rounded(K.strong_pairs(K.spearman(V.features(spark, sf_dir), _NUM, ["row_id"])), "rho")


@query("l7_ranked_pairs", f"""
WITH {_SPEARMAN}
SELECT CAST(row_number() OVER (ORDER BY abs(rho) DESC, col_a, col_b) AS INTEGER) AS place, col_a, col_b, {r('rho', 'rho')}
FROM matrix WHERE abs(rho) > 0.2""")
def l7_ranked_pairs(spark, sf_dir):
    """The places of strong pairs in the order that the operator gives; a row for a pair of columns."""
    ranked = K.strong_pairs(K.spearman(V.features(spark, sf_dir), _NUM, ["row_id"]), 0.2).collect()
    placed = [(i + 1, x["col_a"], x["col_b"], x["rho"]) for i, x in enumerate(ranked)]
    return rounded(spark.createDataFrame(placed, "place int, col_a string, col_b string, rho double"), "rho")


def _drops_sql(priority: list[str], spearman: str = _SPEARMAN, threshold: float = 0.85) -> str:
    listed = ", ".join(f"'{p}'" for p in priority) or "''"
    return f"""
WITH RECURSIVE {spearman},
rates AS (SELECT col, count(*) AS present FROM cells GROUP BY col),
strong AS (
  SELECT m.*, ra.present AS here_a, rb.present AS here_b, col_a IN ({listed}) AS prio_a, col_b IN ({listed}) AS prio_b
  FROM matrix m JOIN rates ra ON ra.col = col_a JOIN rates rb ON rb.col = col_b WHERE abs(rho) > {threshold}),
settled AS (
  SELECT row_number() OVER (ORDER BY abs(rho) DESC, pos_a, pos_b) AS k, col_a, col_b, abs(rho) AS rho,
         CASE WHEN prio_a AND NOT prio_b THEN col_a WHEN prio_b AND NOT prio_a THEN col_b
              WHEN here_a > here_b THEN col_a WHEN here_b > here_a THEN col_b
              ELSE least(col_a, col_b) END AS kept,
         CASE WHEN (prio_a AND NOT prio_b) OR (prio_b AND NOT prio_a) THEN 'priority'
              WHEN here_a <> here_b THEN 'null rate' ELSE 'name' END AS reason
  FROM strong),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone, CAST([] AS BIGINT[]) AS used
  UNION ALL
  SELECT s.k,
         CASE WHEN list_contains(gone, col_a) OR list_contains(gone, col_b) THEN gone
              ELSE list_append(gone, CASE WHEN kept = col_a THEN col_b ELSE col_a END) END,
         CASE WHEN list_contains(gone, col_a) OR list_contains(gone, col_b) THEN used ELSE list_append(used, s.k) END
  FROM walk JOIN settled s ON s.k = walk.k + 1),
final_state AS (SELECT used FROM walk ORDER BY k DESC LIMIT 1)
SELECT CASE WHEN kept = col_a THEN col_b ELSE col_a END AS dropped, kept, {r('rho', 'rho')}, reason
FROM settled, final_state WHERE list_contains(used, k)"""


def _drops(spark, sf_dir, priority):
    drops = K.collinear_drops(V.features(spark, sf_dir), ["row_id"], 0.85, priority, _NUM)
    rows = [(d.dropped, d.kept, d.rho, d.reason) for d in drops]
    return rounded(spark.createDataFrame(rows, "dropped string, kept string, rho double, reason string"), "rho")


@query("c5_drops", _drops_sql([]))
def c5_drops(spark, sf_dir):
    return _drops(spark, sf_dir, [])


@query("c5_drops_priority", _drops_sql(["price_sum", "qty_sum"]))
def c5_drops_priority(spark, sf_dir):
    return _drops(spark, sf_dir, ["price_sum", "qty_sum"])


_EAV_SPEARMAN = f"""{WIDE},
numbered AS (SELECT row_number() OVER (ORDER BY entity_id, obs_date, score) AS row_id, * FROM wide),
cells AS ({stacked('numbered', V.KEYS, keep='row_id')}),
pair_values AS (
  SELECT a.col AS col_a, b.col AS col_b, a.pos AS pos_a, b.pos AS pos_b, a.v AS va, b.v AS vb
  FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.pos < b.pos),""" + _RANKED


@query("c5_drops_from_eav", _drops_sql([], _EAV_SPEARMAN, 0.001))
def c5_drops_from_eav(spark, sf_dir):
    """The filter on a pivoted table, whose index holds the score; a low limit, so that it has work."""
    w = materialise(V.wide(spark, sf_dir))
    drops = K.collinear_drops(w, ["entity_id", "obs_date", "score"], 0.001, [], V.KEYS)
    rows = [(d.dropped, d.kept, d.rho, d.reason) for d in drops]
    return rounded(spark.createDataFrame(rows, "dropped string, kept string, rho double, reason string"), "rho")
