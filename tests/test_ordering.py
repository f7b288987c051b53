import datetime
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsewide.operators import ordering as O
from pulsewide.operators import profile as P
from pulsewide.operators import split as SP


def hot_values(n=5000, seed=3):
    """A third of the rows share one value, the rest is heavy-tailed."""
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(0, 3, n))
    x[: n // 3] = 0.0
    rng.shuffle(x)
    return x


def frame(spark, x):
    return spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)


def test_percentiles_equal_numpy_with_a_hot_value(spark):
    x = hot_values()
    probs = [0.0, 0.01, 0.3, 0.3333, 0.5, 0.95, 0.99, 1.0]
    got = O.percentile_map(frame(spark, x), ["x"], probs)["x"]
    assert np.allclose(got, np.percentile(x, [100 * p for p in probs]), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = O.percentile_map(df, ["x"], [0.0, 0.25, 0.5, 1.0])["x"]
    present = [v for v in values if v is not None]
    if not present:
        assert got == [None] * 4
    else:
        assert np.allclose(got, np.percentile(present, [0, 25, 50, 100]), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    x = np.round(hot_values(3000), 2)
    rows = frame(spark, x).select(F.lit("g").alias("g"), "x")
    counts = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    out = O.running_totals(counts, "g", "x", ["n"], O.value_cuts(counts, "g", "x", rows_per_range=100), descending).collect()
    for r in out:
        want = (x >= r["x"]).sum() if descending else (x <= r["x"]).sum()
        assert r["cum_n"] == want
    assert len(out) == len(np.unique(x))


def test_cuts_follow_the_partitions(spark):
    counts = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("x"))
    assert len(O.value_cuts(counts, "g", "x", rows_per_range=100, max_ranges=20)["g"]) == 19
    assert O.value_cuts(counts, "g", "x") == {"g": []}
    cuts = O.value_cuts(counts, "g", "x", rows_per_range=100, max_ranges=10)["g"]
    assert all(abs(c - 500 * (k + 1)) < 50 for k, c in enumerate(cuts))


def dated(spark, rows):
    return spark.createDataFrame(rows, "id bigint, d date")


def days(*numbers):
    return [None if n is None else datetime.date(2024, 1, 1) + datetime.timedelta(n) for n in numbers]


def test_split_is_exact_and_keeps_time_order(spark):
    rows = list(zip(range(100), days(*[(i * 37) % 11 for i in range(100)])))
    older, newer = SP.oot_split(dated(spark, rows), "d", ["id"], 0.2)
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r["id"] for r in older.collect()} == {r[0] for r in want[:80]}
    assert older.agg(F.max("d")).first()[0] <= newer.agg(F.min("d")).first()[0]
    assert older.count() + newer.count() == 100


def test_split_edges(spark):
    same = dated(spark, list(zip(range(50), days(*[3] * 50))))
    older, newer = SP.oot_split(same, "d", ["id"], 0.3)
    assert (older.count(), newer.count()) == (35, 15)
    one = dated(spark, list(zip([1], days(0))))
    older, newer = SP.oot_split(one, "d", ["id"], 0.2)
    assert (older.count(), newer.count()) == (0, 1)
    missing = dated(spark, list(zip(range(4), days(None, 5, None, 1))))
    older, _ = SP.oot_split(missing, "d", ["id"], 0.5)
    assert {r["id"] for r in older.collect()} == {0, 2}
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            SP.oot_split(same, "d", ["id"], bad)
    with pytest.raises(KeyError):
        SP.oot_split(same, "absent", ["id"])


def test_split_by_text_ids(spark):
    rows = [(f"c{i}", f"r{i % 3}", d) for i, d in enumerate(days(*[i // 40 for i in range(120)]))]
    df = spark.createDataFrame(rows, "a string, b string, d date")
    older, newer = SP.oot_split(df, "d", ["a", "b"], 0.25)
    assert (older.count(), newer.count()) == (90, 30)
    assert older.intersect(newer).count() == 0


def test_folds_expand(spark):
    df = dated(spark, list(zip(range(103), days(*[(i * 7) % 13 for i in range(103)]))))
    folded = SP.expanding_folds(df, "d", ["id"]).collect()
    sizes = [sum(r["fold"] == k for r in folded) for k in range(4)]
    assert sizes == [103 - 3 * 25, 25, 25, 25]
    for k in range(3):
        early = max((r["d"], r["id"]) for r in folded if r["fold"] <= k)
        late = min((r["d"], r["id"]) for r in folded if r["fold"] > k)
        assert early < late
    with pytest.raises(ValueError):
        SP.expanding_folds(dated(spark, list(zip(range(3), days(1, 2, 3)))), "d", ["id"])


def test_samples(spark):
    df = spark.range(5000)
    a, b = SP.sample_at_most(df, ["id"], 700), SP.sample_at_most(df.repartition(9), ["id"], 700)
    assert a.count() == 700 and a.exceptAll(b).count() == 0
    assert SP.sample_at_most(df, ["id"], 9000).count() == 5000
    assert a.exceptAll(SP.sample_rows(df, ["id"], 700)).count() == 0
    assert SP.sample_at_most(df, ["id"], 700, seed=7).exceptAll(a).count() > 0


def test_quantile_bins_drop_repeated_edges(spark):
    x = np.concatenate([np.zeros(60), np.arange(1, 41)])
    df = frame(spark, x).withColumn("c", F.lit(0))
    table = P.quantile_class_mix(df, "x", "c", [0, 1, 2], 8).orderBy("bin").collect()
    assert len(table) == 4 and table[0]["lo"] == 0.0
    edges = np.unique(np.percentile(x, np.arange(9) * 12.5))
    for r in table:
        inside = (x <= r["hi"]) & ((x > r["lo"]) | ((r["bin"] == 0) & (x == r["lo"])))
        assert r["class_0"] == inside.sum() and r["class_1"] == 0
    assert [r["hi"] for r in table] == list(edges[1:])
    assert sum(r["total"] for r in table) == len(x)


def test_histogram_equals_numpy(spark):
    x = hot_values(2000)
    table = P.histogram(frame(spark, x), "x", 20).orderBy("bin").collect()
    want, edges = np.histogram(x, 20)
    assert [r["n"] for r in table] == list(want)
    assert np.allclose([r["lo"] for r in table], edges[:-1])
    flat = P.histogram(frame(spark, [4.0] * 7), "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == list(np.histogram([4.0] * 7, 4)[0])
    assert P.histogram(spark.createDataFrame([(None,)], "x double"), "x", 4).count() == 0


def test_density_equals_direct_sum(spark):
    x = hot_values(800)[:300] % 50
    out = P.kernel_density({"a": frame(spark, x)}, "x", points=40).orderBy("k").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 40)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in out], grid)
    assert np.allclose([r["density"] for r in out], want)


def test_extremes_of_several_ranks_at_once(spark):
    rows = [(i // 10, i) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert O.rows_at_ranks(df, ["a", "b"], [0, 9, 10, 55, 99]) == [[0, 0], [0, 9], [1, 10], [5, 55], [9, 99]]
    with pytest.raises(ValueError):
        O.rows_at_ranks(df, ["a", "b"], [100])


@pytest.mark.parametrize("spread", [1.0, 1e12])
def test_density_equals_the_sum_over_all_values(spark, spread):
    rng = np.random.default_rng(9)
    x = np.append(rng.normal(size=4000), [30.0, spread])
    got = P.kernel_density({"a": spark.createDataFrame([(float(v),) for v in x], "x double")}, "x", points=50).orderBy("k").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, rel=1e-11, abs=1e-14 / h)


def test_density_of_a_constant_population_is_told(spark):
    frames = {"a": spark.createDataFrame([(float(v),) for v in range(9)], "x double"),
              "flat": spark.createDataFrame([(2.0,)] * 4, "x double"), "none": spark.createDataFrame([(None,)], "x double")}
    out = P.kernel_density(frames, "x", points=10).collect()
    assert sorted((r["population"], r["k"], r["x"], r["density"]) for r in out if r["population"] != "a") == [
        ("flat", None, None, None), ("none", None, None, None)]
    assert sum(r["population"] == "a" for r in out) == 10
