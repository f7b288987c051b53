"""Evaluation queries on a fixed score, so that no model is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewide.functions import columns as C
from pulsewide.operators import evaluate as E
from pulsewide.plans import views as V
from pulsewide.plans.catalog.registry import SCORED, query, r, rounded


@query("m1_weights", f"""
WITH {SCORED}
SELECT y, count(*) AS n, {r('sum(count(*)) OVER () / (CAST(count(*) OVER () AS DOUBLE) * count(*))', 'weight')}
FROM scored GROUP BY y""")
def m1_weights(spark, sf_dir):
    return rounded(E.class_weights(V.scored(spark, sf_dir), "y"), "weight")


@query("m7_logloss", f"""
WITH {SCORED}, q AS (SELECT CASE nps_class WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM scored)
SELECT {r('avg(-ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))', 'logloss')}, count(*) AS n,
       CAST(0 AS BIGINT) AS n_unknown FROM q""")
def m7_logloss(spark, sf_dir):
    return rounded(E.log_loss(V.scored(spark, sf_dir), "nps_class", ["p0", "p1", "p2"]), "logloss")


@query("m7_logloss_unknown", f"""
WITH {SCORED}, gaps AS (
  SELECT CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 7 = 0 THEN -1 ELSE nps_class END AS y,
         p0, CASE WHEN row_id % 11 <> 0 THEN p1 END AS p1, p2 FROM scored),
q AS (SELECT CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 END AS p FROM gaps)
SELECT {r('avg(-ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) FILTER (WHERE p IS NOT NULL)', 'logloss')},
       count(p) AS n, count(*) - count(p) AS n_unknown FROM q""")
def m7_logloss_unknown(spark, sf_dir):
    """Rows without a label, of an unknown class or without a probability are counted apart."""
    s = V.scored(spark, sf_dir)
    key = F.col("row_id")
    gaps = s.withColumns({
        "nps_class": F.when(key % 5 == 0, None).when(key % 7 == 0, -1).otherwise(F.col("nps_class")),
        "p1": F.when(key % 11 != 0, F.col("p1")),
    })
    return rounded(E.log_loss(gaps, "nps_class", ["p0", "p1", "p2"]), "logloss")


def _report_sql(threshold: float) -> str:
    return f"""
WITH {SCORED}, d AS (SELECT y, CASE WHEN p >= CAST({threshold} AS DOUBLE) THEN 1 ELSE 0 END AS q FROM scored),
c AS (SELECT k, count_if(y = k AND q = k) AS tp, count_if(q = k) AS pred, count_if(y = k) AS truth
      FROM d, (SELECT unnest([0, 1]) AS k) GROUP BY k),
s AS (SELECT k, coalesce(tp / nullif(CAST(pred AS DOUBLE), 0), 0) AS pr, coalesce(tp / nullif(CAST(truth AS DOUBLE), 0), 0) AS rc,
             coalesce(2 * tp / nullif(CAST(pred + truth AS DOUBLE), 0), 0) AS f1, truth FROM c),
acc AS (SELECT count_if(y = q) / CAST(count(*) AS DOUBLE) AS a, count(*) AS n FROM d),
lines AS (
  SELECT CASE k WHEN 0 THEN 'Non-Detractor' ELSE 'Detractor' END AS class, pr, rc, f1, truth FROM s
  UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
  UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f1), sum(truth) FROM s
  UNION ALL SELECT 'weighted avg', sum(pr * truth) / sum(truth), sum(rc * truth) / sum(truth),
                   sum(f1 * truth) / sum(truth), sum(truth) FROM s)
SELECT class, {r('pr', 'precision')}, {r('rc', 'recall')}, {r('f1', 'f1')}, CAST(truth AS BIGINT) AS support FROM lines"""


_LIKELIEST = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query("e1_report_multi", f"""
WITH {SCORED}, d AS (SELECT nps_class AS y, {_LIKELIEST} AS q FROM scored),
c AS (SELECT k, count_if(y = k AND q = k) AS tp, count_if(q = k) AS pred, count_if(y = k) AS truth
      FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
s AS (SELECT k, coalesce(tp / nullif(CAST(pred AS DOUBLE), 0), 0) AS pr, coalesce(tp / nullif(CAST(truth AS DOUBLE), 0), 0) AS rc,
             coalesce(2 * tp / nullif(CAST(pred + truth AS DOUBLE), 0), 0) AS f1, truth FROM c),
acc AS (SELECT count_if(y = q) / CAST(count(*) AS DOUBLE) AS a, count(*) AS n FROM d),
lines AS (
  SELECT CASE k WHEN 0 THEN 'Detractor' WHEN 1 THEN 'Passive' ELSE 'Promoter' END AS class, pr, rc, f1, truth FROM s
  UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
  UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f1), sum(truth) FROM s
  UNION ALL SELECT 'weighted avg', sum(pr * truth) / sum(truth), sum(rc * truth) / sum(truth),
                   sum(f1 * truth) / sum(truth), sum(truth) FROM s)
SELECT class, {r('pr', 'precision')}, {r('rc', 'recall')}, {r('f1', 'f1')}, CAST(truth AS BIGINT) AS support FROM lines""")
def e1_report_multi(spark, sf_dir):
    """The report of a three-class model, by its likeliest class."""
    p = F.array("p0", "p1", "p2")
    decided = V.scored(spark, sf_dir).withColumn("q", (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return rounded(E.report(decided, "nps_class", "q", [0, 1, 2]), "precision", "recall", "f1")


def _report(spark, sf_dir, threshold):
    decided = V.scored(spark, sf_dir).withColumn("q", C.decide(F.col("p"), threshold))
    return rounded(E.report(decided, "y", "q", [0, 1]), "precision", "recall", "f1")


@query("e1_report", _report_sql(0.5))
def e1_report(spark, sf_dir):
    return _report(spark, sf_dir, 0.5)


@query("e6_report_tuned", _report_sql(0.35))
def e6_report_tuned(spark, sf_dir):
    """The report at the tuned threshold, which comes from the data."""
    tuned = E.optimal_threshold(V.scored(spark, sf_dir), "y", "p", [0, 1], 2.0)
    return _report(spark, sf_dir, tuned)


@query("p22_decide", f"""
WITH {SCORED}
SELECT row_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS decided,
       CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS likeliest
FROM scored""")
def p22_decide(spark, sf_dir):
    s = V.scored(spark, sf_dir)
    probabilities = F.array("p0", "p1", "p2")
    return s.select(
        "row_id",
        C.decide(F.col("p"), 0.5).alias("decided"),
        (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int").alias("likeliest"),
    )


@query("e2_confusion", f"""
WITH {SCORED}, d AS (SELECT nps_class AS y, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS q FROM scored),
k AS (SELECT unnest([0, 1, 2]) AS y),
t AS (SELECT k.y, count_if(q = 0) AS pred_0, count_if(q = 1) AS pred_1, count_if(q = 2) AS pred_2, greatest(count(q), 1) AS n
      FROM k LEFT JOIN d ON k.y = d.y GROUP BY k.y)
SELECT CAST(y AS INTEGER) AS y, CAST(pred_0 AS BIGINT) AS pred_0, CAST(pred_1 AS BIGINT) AS pred_1, CAST(pred_2 AS BIGINT) AS pred_2,
       {r('pred_0 * 100.0 / n', 'pred_0_pct')}, {r('pred_1 * 100.0 / n', 'pred_1_pct')}, {r('pred_2 * 100.0 / n', 'pred_2_pct')}
FROM t""")
def e2_confusion(spark, sf_dir):
    probabilities = F.array("p0", "p1", "p2")
    decided = V.scored(spark, sf_dir).withColumn(
        "q", (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
    )
    out = E.confusion(decided, "nps_class", "q", [0, 1, 2])
    return rounded(out, "pred_0_pct", "pred_1_pct", "pred_2_pct")


def _curve(beta: float) -> str:
    b = beta * beta
    return f"""{SCORED}, d AS (SELECT p AS threshold, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p),
cum AS (SELECT threshold, sum(n) OVER w AS predicted, sum(pos) OVER w AS tp, sum(pos) OVER () AS positives
        FROM d WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT threshold, predicted, tp, tp / CAST(predicted AS DOUBLE) AS pr, tp / CAST(positives AS DOUBLE) AS rc FROM cum),
curve AS (SELECT *, coalesce((1 + {b}) * pr * rc / nullif({b} * pr + rc, 0), 0) AS fb FROM pr)"""


_CURVE_COLS = (
    f"threshold, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp, "
    f"{r('pr', 'precision')}, {r('rc', 'recall')}, {r('fb', 'fbeta')}"
)


@query("e3_pr_curve", f"WITH {_curve(2.0)} SELECT {_CURVE_COLS} FROM curve")
def e3_pr_curve(spark, sf_dir):
    return rounded(E.precision_recall(V.scored(spark, sf_dir), "y", "p", 2.0), "precision", "recall", "fbeta")


@query("e4_threshold", f"WITH {_curve(2.0)} SELECT {_CURVE_COLS} FROM curve ORDER BY fb DESC, threshold LIMIT 1")
def e4_threshold(spark, sf_dir):
    return rounded(E.best_threshold(V.scored(spark, sf_dir), "y", "p", 2.0), "precision", "recall", "fbeta")


@query("e4_threshold_f1", f"WITH {_curve(1.0)} SELECT {_CURVE_COLS} FROM curve ORDER BY fb DESC, threshold LIMIT 1")
def e4_threshold_f1(spark, sf_dir):
    return rounded(E.best_threshold(V.scored(spark, sf_dir), "y", "p", 1.0), "precision", "recall", "fbeta")


@query("e5_expected_score", f"WITH {SCORED} SELECT row_id, {r('(p2 - p0) * 100', 'expected_score')} FROM scored")
def e5_expected_score(spark, sf_dir):
    rows = V.scored(spark, sf_dir).select("row_id", F.array("p0", "p1", "p2").alias("probabilities"))
    scored = E.with_expected_score(rows, "probabilities", [0, 1, 2])
    return rounded(scored.select("row_id", "expected_score"), "expected_score")
