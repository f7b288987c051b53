import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewide.operators import evaluate as E


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y int, p double").repartition(4)


def test_threshold_attains_the_best_f(spark):
    rng = np.random.default_rng(2)
    y = rng.random(900) < 0.3
    p = np.where(rng.random(900) < 0.34, 0.25, np.round(0.3 * y + 0.7 * rng.random(900), 3))
    df = scored(spark, zip(y, p))

    def f(t, beta):
        hit = p >= t
        tp = (hit & y).sum()
        if tp == 0:
            return 0.0
        pr, rc = tp / hit.sum(), tp / y.sum()
        return (1 + beta**2) * pr * rc / (beta**2 * pr + rc)

    for beta in (1.0, 2.0):
        every = {t: f(t, beta) for t in np.unique(p)}
        got = E.optimal_threshold(df, "y", "p", [0, 1], beta)
        assert every[got] == pytest.approx(max(every.values()), abs=1e-12)
    curve = E.precision_recall(df, "y", "p").collect()
    assert len(curve) == len(np.unique(p))


def test_curve_edges(spark):
    flat = E.precision_recall(scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5)]), "y", "p").collect()
    assert len(flat) == 1 and flat[0]["precision"] == pytest.approx(1 / 3) and flat[0]["recall"] == 1.0
    none = E.precision_recall(scored(spark, [(0, 0.1), (0, 0.2)]), "y", "p").collect()
    assert all(r["fbeta"] == 0.0 and r["recall"] == 1.0 for r in none)
    with pytest.raises(ValueError):
        E.optimal_threshold(scored(spark, [(0, 0.1)]), "y", "p", [0, 1, 2])


def test_report_without_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, q int")
    rows = {r["class"]: r for r in E.report(df, "y", "q", [0, 1]).collect()}
    assert (rows["Detractor"]["precision"], rows["Detractor"]["recall"], rows["Detractor"]["f1"]) == (0.0, 0.0, 0.0)
    assert rows["Non-Detractor"]["precision"] == pytest.approx(2 / 3)
    assert rows["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert rows["weighted avg"]["support"] == 3


def test_report_and_matrix_with_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2)], "y int, q int")
    rows = {r["class"]: r for r in E.report(df, "y", "q", [0, 1, 2]).collect()}
    assert rows["Passive"]["support"] == 0 and rows["Passive"]["f1"] == 0.0
    matrix = {r["y"]: r for r in E.confusion(df, "y", "q", [0, 1, 2]).collect()}
    assert [matrix[1][f"pred_{c}"] for c in (0, 1, 2)] == [0, 0, 0]
    assert matrix[1]["pred_0_pct"] == 0.0 and matrix[0]["pred_2_pct"] == 50.0


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 0.0), (1, 0.5, 0.5)], "y int, a double, b double")
    got = E.log_loss(df, "y", ["a", "b"]).first()["logloss"]
    eps = np.finfo(float).eps
    assert got == pytest.approx((-math.log(1 - eps) - math.log(eps) - math.log(0.5)) / 3)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in E.class_weights(df, "y").collect()} == {0: 8 / 12, 1: 2.0}


def test_expected_score(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5],)], "p array<double>")
    assert E.with_expected_score(df, "p", [0, 1, 2]).first()["expected_score"] == pytest.approx(30.0)
    with pytest.raises(ValueError):
        E.with_expected_score(df, "p", [0, 1])


def test_labels():
    from pulsewide.functions.columns import labels_for

    assert labels_for([0, 1])[1] == "Detractor"
    assert labels_for([2, 1, 0])[0] == "Detractor"
    assert labels_for([4, 9]) == {4: "Class 4", 9: "Class 9"}


def test_score_at_threshold_counts_as_positive(spark):
    from pulsewide.functions.columns import decide

    df = spark.createDataFrame([(0.5,), (0.49,)], "p double")
    assert [r[0] for r in df.select(decide(F.col("p"), 0.5)).collect()] == [1, 0]
