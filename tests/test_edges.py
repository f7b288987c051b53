"""Cases that once threw or gave a wrong number."""

import math

import pytest
from pyspark.sql import functions as F

from pulsewide.operators import evaluate as E
from pulsewide.operators import matrix as MX
from pulsewide.operators import profile as P
from pulsewide.operators import split as SP
from pulsewide.session import delete_scratch, materialise, shared_dir


def test_log_loss_leaves_unknown_rows_out(spark):
    rows = [(0, 0.5, 0.5), (1, 0.5, 0.5), (None, 0.9, 0.1), (-1, 0.9, 0.1), (1, 0.1, None)]
    r = E.log_loss(spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"]).first()
    assert (round(r["logloss"], 6), r["n"], r["n_unknown"]) == (round(math.log(2), 6), 2, 3)


def test_curve_leaves_unlabelled_rows_out(spark):
    df = spark.createDataFrame([(1, 0.9), (None, 0.8), (0, 0.1)], "y int, p double")
    rows = {r["threshold"]: (r["predicted"], r["tp"]) for r in E.precision_recall(df, "y", "p").collect()}
    assert rows == {0.9: (1, 1), 0.1: (2, 1)}


def test_exposure_of_an_empty_population(spark):
    empty = spark.createDataFrame([], "x double")
    assert [tuple(r) for r in P.exposure({"none": empty}, "x").collect()] == [("none", 0.0, 0.0, 0.0)]


def test_base_rate_at_the_ends(spark):
    for label in (0, 1):
        r = P.base_rate(spark.createDataFrame([(label,)] * 3, "y int"), "y").first()
        assert r["naive_logloss"] == 0.0


def test_sample_of_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1,)] * 20, "k int")
    assert SP.sample_at_most(df, ["k"], 5).count() == 5
    assert SP.sample_at_most(spark.range(50).withColumn("k", F.col("id") % 7), ["k"], 20).count() == 20


def test_extremes_with_text_keys_and_ties(spark):
    df = spark.createDataFrame([("b", 0.95), ("a", 0.95), ("c", 0.05), ("d", None)], "who_id string, p double")
    assert [tuple(r) for r in P.extremes(df, "p", "who_id").collect()] == [("high", "a", 0.95, True), ("low", "c", 0.05, True)]


def test_too_many_levels_are_an_error(spark):
    df = spark.createDataFrame([(f"t{i}", float(i)) for i in range(30)], "t string, x double")
    with pytest.raises(ValueError, match="more than 20 levels.*'t': 30"):
        MX.fit_matrix(df, ["t", "x"], max_levels=20)


def test_density_shuffles_one_row_per_point_and_task(spark):
    frames = {"a": spark.range(1000).select((F.col("id") * 1.0).alias("x")), "b": spark.range(50).select((F.col("id") * 2.0).alias("x"))}
    plan = P.kernel_density(frames, "x", points=20)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_shares_use_no_window(spark):
    plan = P.shares(spark.range(10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_split_mark_scans_once(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    marked = SP.oot_mark(rows, "d", ["o_orderkey"])
    assert marked._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_scratch_can_be_deleted(spark):
    new = spark.newSession()
    kept = materialise(new.range(3).toDF("x"))
    assert kept.count() == 3 and shared_dir(new) == shared_dir(spark)
    assert callable(delete_scratch)
