"""Boosting on binned rows against MLlib's, on rows built here."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsewide.operators import boosting as B
from pulsewide.operators import model as M
from pulsewide.operators.evaluate import log_loss
from pulsewide.operators.matrix import FEATURES, LABEL, fit_matrix
from pulsewide.session import materialise

COLUMNS = ["x", "z", "few", "name", "flag"]
PARAMS = {"learning_rate": 0.1, "num_leaves": 32, "min_child_samples": 7, "colsample_bytree": 0.7}


def _rows(spark, n=3000, nulls=True):
    rng = np.random.default_rng(5)
    x, z, noise = rng.normal(size=n), rng.uniform(0, 50, n).round(1), rng.random(n)
    few, name = rng.integers(0, 4, n), rng.integers(0, 9, n)
    label = np.where(noise < 0.1, rng.integers(0, 3, n), (x + z / 25 + name % 3 > 1.5).astype(int) + (few > 1))
    rows = [
        (i, None if nulls and i % 13 == 0 else float(x[i]), float(z[i]), int(few[i]), None if i % 17 == 0 else f"n{name[i]}", i % 5 == 0, int(label[i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id int, x double, z double, few int, name string, flag boolean, label int")
    return materialise(df.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 10).cast("int"))))


def _ready(spark, df, weighted):
    matrix = fit_matrix(df, COLUMNS, label=LABEL)
    ready = matrix.transform(df).select((F.col(LABEL) > 0).cast("double").alias(LABEL), FEATURES, "id")
    return materialise(M.with_balanced_weight(ready) if weighted else ready), matrix.layout.max_levels


def _margins(model, ready):
    return np.array([r["m"] for r in model.transform(ready).orderBy("id").select(vector_to_array("rawPrediction")[1].alias("m")).collect()])


@pytest.mark.parametrize("share", [0.7, 1.0])
def test_trees_are_those_of_mllib(spark, share):
    # a NULL makes mirrored splits, between which rounding decides; that moves the draws of columns
    ready, levels = _ready(spark, _rows(spark, nulls=share == 1.0), False)
    estimator = M.build(M.BINARY, {**PARAMS, "colsample_bytree": share}, 12, levels)
    estimator.clear(estimator.weightCol)
    want = estimator.fit(ready)
    found = B.find_binning(ready, estimator)
    rows = B.packed(ready, found, LABEL, FEATURES)
    trees, _ = B.boost(found, B.settings_of(estimator, found), rows)
    got = B.to_model(spark, estimator, trees)
    assert got.getNumTrees == want.getNumTrees == 12 and got.treeWeights == want.treeWeights
    assert got.numFeatures == want.numFeatures and got.trees[0].numNodes == want.trees[0].numNodes
    assert np.abs(_margins(got, ready) - _margins(want, ready)).max() < 1e-9
    codes, _, _ = rows.first()
    assert codes.dtype == np.uint8 and len(codes) < len(found.sizes)  # a row is fewer bytes than it has slots


def test_classes_are_boosted_without_mllib_passes(spark, monkeypatch):
    """Every pass of MLlib's took all columns of all rows: none is made."""
    df = _rows(spark)
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda *a: pytest.fail("MLlib's own passes"))
    model = M.train_boosted_classes(df, COLUMNS, PARAMS, ["day", "id"], rounds=3)
    assert [m.getNumTrees for m in model.models] == [3, 3, 3]
    assert all(sum(r["p"]) == pytest.approx(1) for r in model.score(df).collect())


def test_loss_of_a_fold_is_that_of_mllib(spark):
    """Inside one task or as jobs, with weights by class; rows of the fold grow no tree."""
    df = _rows(spark)
    ready, levels = _ready(spark, df, False)
    ready = materialise(ready.withColumn("fold", (F.col("id") / 1000).cast("int")))
    past = ready.where("fold < 2")
    estimator = M.build(M.BINARY, {**PARAMS, "colsample_bytree": 1.0}, 8, levels)
    p = vector_to_array("probability")
    scored = estimator.fit(M.with_balanced_weight(past)).transform(ready.where("fold = 2"))
    want = log_loss(scored.select(LABEL, p[0].alias("p0"), p[1].alias("p1")), LABEL, ["p0", "p1"]).first()["logloss"]
    for alone in (True, False):
        assert M._Folds(ready, past, 2, estimator, alone).loss(estimator) == pytest.approx(want, abs=1e-9)


def test_lineage_is_cut_and_one_class_grows_no_tree(spark):
    ready, levels = _ready(spark, _rows(spark, 400), False)
    estimator = M.build(M.BINARY, PARAMS, 2 * B._WRITE_EVERY + 2, levels)
    estimator.clear(estimator.weightCol)
    found = B.find_binning(ready, estimator)
    settings, rows = B.settings_of(estimator, found), B.packed(ready, found, LABEL, FEATURES)
    _, (total, n) = B.boost(found, settings, rows.map(lambda r: (*r[:2], r[1])), 1e-16)
    assert (total / n, n) == (pytest.approx(B.boost_here(found, settings, rows.map(lambda r: (*r[:2], r[1])).collect(), 1e-16)[0] / n), n)
    trees, losses = B.boost(found, settings, rows.map(lambda r: (r[0], np.ones_like(r[1]), r[2])))
    assert losses is None and all(len(t.predictions) == 1 for t in trees) and trees[0].predictions[0] == 1.0
    assert B.to_model(spark, estimator, trees).totalNumNodes == len(trees)


def test_labels_that_are_no_class_are_refused(spark):
    ready, levels = _ready(spark, _rows(spark, 200), False)
    estimator = M.build(M.BINARY, PARAMS, 1, levels)
    estimator.clear(estimator.weightCol)
    with pytest.raises(Exception, match="(?i)label"):
        B.find_binning(ready.withColumn(LABEL, F.when(F.col("id") > 3, F.col(LABEL))), estimator)
