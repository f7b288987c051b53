import numpy as np
import pytest

from pulsewide.operators import correlate as K

COLS = ["a", "b", "c", "d", "e", "flat", "empty"]


def average_ranks(x):
    order = np.argsort(x, kind="stable")
    ranks = np.empty(len(x))
    ranks[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        ranks[x == v] = ranks[x == v].mean()
    return ranks


def brute(data, method):
    out = {}
    for i, p in enumerate(COLS):
        for q in COLS[i + 1:]:
            both = ~np.isnan(data[p]) & ~np.isnan(data[q])
            x, y = data[p][both], data[q][both]
            if method == "spearman":
                x, y = average_ranks(x), average_ranks(y)
            defined = both.sum() > 1 and np.ptp(x) > 0 and np.ptp(y) > 0
            out[p, q] = (np.corrcoef(x, y)[0, 1] if defined else None, int(both.sum()))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 600
    a = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))     # a hot value
    b = a * 2 + rng.normal(size=n) * 0.01
    c = np.round(rng.normal(size=n), 1)
    d = np.exp(a) + 1e6
    e = rng.normal(size=n)
    b[::4] = np.nan
    d[::4] = np.nan
    c[::7] = np.nan
    e[1:] = np.nan                                                 # one row only
    return dict(a=a, b=b, c=c, d=d, e=e, flat=np.full(n, 0.1), empty=np.full(n, np.nan))


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [
        (i, *[None if np.isnan(data[c][i]) else float(data[c][i]) for c in COLS]) for i in range(len(data["a"]))
    ]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in COLS)).repartition(6)


def as_dict(matrix):
    return {(r["col_a"], r["col_b"]): (r["rho"], r["n"]) for r in matrix.collect()}


def same(got, want):
    assert set(got) == set(want)
    for pair, (rho, n) in want.items():
        assert got[pair][1] == n, pair
        if rho is None:
            assert got[pair][0] is None, pair
        else:
            assert got[pair][0] == pytest.approx(rho, abs=1e-9), pair


def test_pearson(table, data):
    same(as_dict(K.pearson(table, COLS)), brute(data, "pearson"))


@pytest.mark.parametrize("hot_share", [None, K.HOT_SHARE, 1.0])
def test_spearman(table, data, hot_share):
    same(as_dict(K.spearman(table, COLS, ["id"], hot_share)), brute(data, "spearman"))


@pytest.mark.parametrize("partitions", ["1", "3", "29"])
def test_ranks_in_any_number_of_ranges(spark, table, data, partitions):
    """A value of two fifths of the rows covers several whole ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(as_dict(K.spearman(table, COLS, ["id"])), brute(data, "spearman"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_ranks_over_small_batches(spark, table, data):
    """Blocks of ties go on from batch to batch."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(as_dict(K.spearman(table, COLS, ["id"])), brute(data, "spearman"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_more_columns_than_bits_of_a_word(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, (40, 66)).astype(float)
    values[rng.random(values.shape) < 0.3] = np.nan
    names = [f"c{i}" for i in range(66)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names))
    got = as_dict(K.spearman(df, names, ["id"]))
    for a, b in [(0, 1), (0, 65), (61, 62), (63, 64)]:
        both = ~np.isnan(values[:, a]) & ~np.isnan(values[:, b])
        x, y = average_ranks(values[both, a]), average_ranks(values[both, b])
        assert got[names[a], names[b]] == (pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9), both.sum())


def test_cells_are_exchanged_twice(spark, table):
    """Once by ranges, once by row; nothing else moves them."""
    masks = K._mask_classes(table, COLS)
    placed = K._placed(K._ranged_cells(table, COLS, masks, ["id"]), len(masks.representative))
    plan = K._products(placed, len(COLS), masks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("numbers, ranged", [(0, ["a", "b", "c", "d", "e", "flat"]), (600, ["a", "b", "d"])])
def test_only_columns_of_many_values_are_ranged(table, data, monkeypatch, numbers, ranged):
    """Ranks of the others are held; both kinds meet by row."""
    seen, ranged_cells = [], K._ranged_cells

    def spied(*args):
        seen.append(ranged_cells(*args))
        return seen[-1]

    monkeypatch.setattr(K, "_ranged_cells", spied)
    monkeypatch.setattr(K, "HELD_NUMBERS", numbers)
    same(as_dict(K.spearman(table, COLS, ["id"])), brute(data, "spearman"))
    assert {COLS[r["pos"]] for r in seen[0].select("pos").distinct().collect()} == set(ranged)


def test_few_values_are_not_exchanged_cell_by_cell(table, data, monkeypatch):
    monkeypatch.setattr(K, "_ranged_cells", lambda *args: pytest.fail("ranged"))
    few = ["c", "e", "flat", "empty"]
    want = {p: v for p, v in brute(data, "spearman").items() if set(p) <= set(few)}
    same(as_dict(K.spearman(table, few, ["id"])), want)


def test_held_and_ranged_cells_over_small_batches(spark, table, data, monkeypatch):
    """Rows go on from batch to batch, and blocks of ties."""
    monkeypatch.setattr(K, "HELD_NUMBERS", 600)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        same(as_dict(K.spearman(table, COLS, ["id"])), brute(data, "spearman"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("numbers", [0, 1 << 20])
def test_infinite_and_signed_zero_values(spark, monkeypatch, numbers):
    monkeypatch.setattr(K, "HELD_NUMBERS", numbers)
    inf = float("inf")
    x, y = [0.0, -0.0, inf, -inf, 3.0, None], [1.0, 2.0, 5.0, 0.0, 4.0, 9.0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    (r,) = K.spearman(df, ["x", "y"], ["id"]).collect()
    want = np.corrcoef([2.5, 2.5, 5, 1, 4], [2, 3, 5, 1, 4])[0, 1]
    assert r["n"] == 5 and r["rho"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("numbers", [0, 1 << 20])
def test_more_columns_than_bits_of_a_word_either_way(spark, monkeypatch, numbers):
    monkeypatch.setattr(K, "HELD_NUMBERS", numbers)
    test_more_columns_than_bits_of_a_word(spark)


def test_repeated_row_key_is_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (2, 3.0, 1.0)], "id int, x double, y double")
    with pytest.raises(ValueError, match="repeat the key"):
        K.spearman(df, ["x", "y"], ["id"])


def test_pearson_ignores_values_outside_the_overlap(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=50)
    y = x + 0.2 * rng.normal(size=50)
    for outlier in (1e9, 1e15, -1e200):
        rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(outlier, None)]
        (r,) = K.pearson(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()
        assert r["n"] == 50 and r["rho"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, nan, 9.0), (4, 3.0, nan), (5, 4.0, 1.0)], "id int, x double, y double")
    (r,) = K.spearman(df, ["x", "y"], ["id"]).collect()
    assert r["n"] == 3 and r["rho"] == pytest.approx(-0.5)


def test_choice_of_drops():
    nulls = dict(a=10.0, b=10.0, c=20.0, d=0.0)
    order = ["a", "b", "c", "d"]
    pick = lambda pairs, priority=(): [(x.dropped, x.kept, x.reason) for x in K.choose_drops(pairs, nulls, order, priority)]
    assert pick([("a", "b", 0.9)]) == [("b", "a", "name")]
    assert pick([("a", "c", -0.9)]) == [("c", "a", "null rate")]
    assert pick([("a", "c", 0.9)], ["c"]) == [("a", "c", "priority")]
    assert pick([("a", "c", 0.9)], ["a", "c"]) == [("c", "a", "null rate")]
    # the strongest pair goes first and settles the pairs of the dropped column
    assert pick([("a", "b", 0.9), ("b", "d", 0.99)]) == [("b", "d", "null rate")]
    # equal strength keeps column order
    assert pick([("b", "c", 0.9), ("a", "b", 0.9)]) == [("b", "a", "name")]


def test_filter(table):
    kept, drops = K.collinearity_filter(table.select("id", "a", "b", "d", "flat"), ["id"])
    assert {d.dropped for d in drops} == {"b", "d"}
    # the id is numeric and no meta column here, so it takes part and stays
    assert kept.columns == ["id", "a", "flat"]
    _, drops = K.collinearity_filter(table.select("id", "a", "b"), ["id"], priority=["b"])
    assert [(d.dropped, d.kept, d.reason) for d in drops] == [("a", "b", "priority")]
    same_frame, none = K.collinearity_filter(table.select("a"), ["a"])
    assert none == [] and same_frame.columns == ["a"]
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            K.collinear_drops(table, ["id"], bad)


def test_matrix_columns(table):
    assert K.matrix_columns(table, COLS) == ["a", "b", "c", "d"]
