"""Model operators: no SQL can repeat them, so these check what must hold."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsewide.operators import attribute as A
from pulsewide.operators import counterfactual as X
from pulsewide.operators import matrix as MX
from pulsewide.operators import model as M
from pulsewide.operators.split import oot_split
from pulsewide.plans import views as V
from pulsewide.plans.catalog import modelling as Q


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return Q.fitted(spark, sf)


@pytest.fixture(scope="module")
def live(spark, sf):
    return V.model_rows(spark, sf)


def margins(classifier, rows):
    raw = classifier.score(rows).select("row_id", F.col("p")[1].alias("p")).collect()
    return {r["row_id"]: math.log(r["p"] / (1 - r["p"])) for r in raw}


def test_contributions_add_up_to_the_log_odds(fitted, live):
    classifier, explainer = fitted
    want = margins(classifier, live)
    got = A.attribute(live, classifier, explainer, ["row_id"]).collect()
    assert len(got) == len(want)
    for r in got:
        assert explainer.base_value + sum(r["shap"]) == pytest.approx(want[r["row_id"]], abs=1e-9)


def leaf_value(tree, x, known, leaf):
    """Weight with which a row reaches a leaf when only some columns are known."""
    weight = 1.0
    for player, cover, tests in zip(leaf.players, leaf.cover, leaf.tests):
        if player not in known:
            weight *= cover
            continue
        for number, goes_left in tests:
            s = tree.splits[number]
            left = x[s.slot] <= s.threshold if s.left_levels is None else x[s.slot] in s.left_levels
            if left != goes_left:
                return 0.0
    return weight * leaf.value


def test_contributions_equal_brute_force_shapley(fitted, live):
    classifier, explainer = fitted
    some = live.where("row_id < 6 or delay_days is null").limit(8)
    inputs = {
        r["row_id"]: r["x"]
        for r in classifier.matrix.transform(some).select("row_id", vector_to_array("features").alias("x")).collect()
    }
    players = range(len(explainer.columns))

    def worth(x, known):
        return sum(leaf_value(t, x, known, l) for t in explainer.trees for l in t.leaves)

    for r in A.attribute(some, classifier, explainer, ["row_id"]).collect():
        x = inputs[r["row_id"]]
        n = len(explainer.columns)
        value = {k: worth(x, set(k)) for size in range(n + 1) for k in itertools.combinations(players, size)}
        for i in players:
            total = 0.0
            for k, v in value.items():
                if i not in k:
                    w = math.factorial(len(k)) * math.factorial(n - len(k) - 1) / math.factorial(n)
                    total += w * (value[tuple(sorted((*k, i)))] - v)
            assert r["shap"][i] == pytest.approx(total, abs=1e-10)


def test_long_paths_use_the_same_formula():
    rng = np.random.default_rng(1)
    d = 10
    cover = tuple(rng.uniform(0.2, 0.9, d))
    leaf = A.Leaf(1.5, tuple(range(d)), cover, tuple(((i, True),) for i in range(d)))
    tree = A.Tree(tuple(A.Split(i, 0.0, None) for i in range(d)), (leaf,))
    explainer = A.Explainer(tuple(f"c{i}" for i in range(d)), (tree,))
    x = rng.normal(size=(64, d))
    x[:8] = -1.0
    phi = A.attribute_block(x, explainer).T
    reached = np.where((x <= 0).all(axis=1), 1.5, 0.0)
    assert np.allclose(phi.sum(axis=1) + explainer.base_value, reached)


def test_blocks_change_nothing(fitted):
    classifier, explainer = fitted
    x = np.random.default_rng(4).uniform(0, 300, (200, len(classifier.matrix.layout.slots)))
    whole = A.attribute_block(x, explainer)
    for size in (1, 3, 70):  # fewer rows than patterns, and more
        parts = [A.attribute_block(x[k : k + size], explainer) for k in range(0, 200, size)]
        assert np.allclose(np.hstack(parts), whole, atol=1e-12)


def test_single_leaf_tree_contributes_nothing():
    tree = A.Tree((), (A.Leaf(0.7, (), (), ()),))
    explainer = A.Explainer(("a", "b"), (tree,))
    assert explainer.base_value == 0.7
    assert not A.attribute_block(np.ones((3, 2)), explainer).any()


def test_importance_and_waterfall(spark, fitted, live):
    classifier, explainer = fitted
    attributed = A.attribute(live, classifier, explainer, ["row_id", "delay_days"])
    rows = attributed.collect()
    top = A.top_importance(attributed, explainer, 3).collect()
    want = np.abs([r["shap"] for r in rows]).mean(axis=0)
    assert [t["mean_abs_shap"] for t in top] == pytest.approx(sorted(want, reverse=True)[:3])
    steps = A.waterfall(attributed, explainer, "row_id", 3).orderBy("rank").collect()
    assert steps[0]["from_logodds"] == pytest.approx(explainer.base_value)
    assert steps[-1]["to_logodds"] == pytest.approx(margins(classifier, live.where("row_id = 3"))[3], abs=1e-9)
    assert all(abs(a["shap"]) >= abs(b["shap"]) for a, b in zip(steps, steps[1:]))
    with pytest.raises(IndexError):
        A.waterfall(attributed, explainer, "row_id", -5)
    ranges = A.directional(attributed, explainer, ["delay_days"]).collect()
    assert sum(r["n"] for r in ranges) == len(rows)
    assert {r["value_range"] for r in ranges} >= {None, 0}


def test_counterfactual_without_columns_changes_nothing(fitted, live):
    classifier, _ = fitted
    r = X.rates(live, [], classifier).first()
    assert r["ate"] == 0.0 and r["relative_reduction"] == 0.0 and r["n"] == live.count()


def test_counterfactual_equals_separate_scoring(fitted, live):
    classifier, explainer = fitted
    with pytest.warns(UserWarning, match="absent"):
        out = X.simulate(live, classifier, explainer, [V.DELAY, V.FLAG, "absent"], ["row_id"])
    assert out.absent == ["absent"]
    assert out.changed.where(F.col(V.DELAY).isNull() | (F.col(V.DELAY) != 0)).count() == 0
    s = out.summary.first()
    mean = lambda df: classifier.score_positive(df).agg(F.avg("p")).first()[0]
    assert s["baseline_rate"] == pytest.approx(mean(live))
    assert s["cf_rate"] == pytest.approx(mean(out.changed))
    assert s["ate"] == pytest.approx(s["baseline_rate"] - s["cf_rate"])


def test_lever_after_the_intervention_is_not_an_intervened_one(spark, sf):
    r = Q.x8_new_lever(spark, sf).first()
    assert r["lever"] == V.DELAY and r["new_lever"] not in Q.INTERVENTION
    assert r["ratio"] == pytest.approx(r["lever_mean_abs_shap"] / r["new_mean_abs_shap"])


def test_model_learns(spark, sf):
    rows = {r["class"]: r for r in Q.m2_gbt(spark, sf).collect()}
    assert rows["accuracy"]["f1"] > 0.7


def test_saved_classifier_scores_the_same(spark, fitted, live, tmp_path):
    classifier, _ = fitted
    classifier.save(spark, str(tmp_path / "c"))
    back = M.Classifier.load(spark, str(tmp_path / "c"))
    assert back.matrix.layout == classifier.matrix.layout
    a = classifier.score_positive(live).select("row_id", "p")
    assert a.exceptAll(back.score_positive(live).select("row_id", "p")).count() == 0


def test_new_data_is_aligned(spark, fitted, live):
    """An absent column, an extra one and an unseen category all score."""
    classifier, _ = fitted
    odd = live.drop("disc_avg", "label").withColumns({"priority": F.lit("never seen"), "extra": F.lit(1)})
    odd = odd.select(*reversed(odd.columns))
    scored = classifier.score_positive(odd)
    assert scored.where(F.col("p").isNull()).count() == 0 and scored.count() == live.count()
    null_category = classifier.score_positive(live.withColumn("priority", F.lit(None).cast("string")))
    a = {r["row_id"]: r["p"] for r in classifier.score_positive(live.withColumn("priority", F.lit("never seen"))).collect()}
    assert all(r["p"] == a[r["row_id"]] for r in null_category.select("row_id", "p").collect())


def test_matrix_keeps_missing_apart(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, None, 2), (3, float("nan"), 3)], "id int, x double, z int")
    m = MX.fit_matrix(df, ["x", "z"])
    rows = [list(r["features"]) for r in m.transform(df).orderBy("id").collect()]
    assert rows == [[5.0, 0.0, 1.0], [4.0, 1.0, 2.0], [4.0, 1.0, 3.0]]
    assert m.layout.slots == [0, 0, 1]
    with pytest.raises(TypeError):
        MX.fit_matrix(df.withColumn("d", F.current_date()), ["x", "d"])


def test_targets(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (-1,)], "nps_class tinyint")
    assert sorted(r["label"] for r in MX.binary_target(df).collect()) == [0, 0, 1]
    assert sorted(r["label"] for r in MX.multi_target(df).collect()) == [0, 1, 2]
    with pytest.raises(KeyError):
        MX.binary_target(df, "absent")
    meta = MX.feature_columns(df.withColumns({"npsDate": F.lit(1), "f": F.lit(1), "label": F.lit(0)}))
    assert meta == ["f"]


def test_categories_outside_the_domain_are_null(spark):
    df = spark.createDataFrame([(i, f"c{i % 7}") for i in range(70)] + [(99, None)], "id int, c string")
    domain = spark.createDataFrame([(f"c{i}",) for i in range(5)], "c string")
    out = {r["id"]: r["c"] for r in MX.align_categories(df, "c", domain).collect()}
    assert out == {i: f"c{i % 7}" if i % 7 < 5 else None for i in range(70)} | {99: None}



def test_three_class_model(spark, sf):
    summary = Q.m3_rf(spark, sf).first()
    assert -100 <= summary["min"] <= summary["median"] <= summary["max"] <= 100


def test_search(spark, sf):
    rows = V.model_rows(spark, sf)
    older, _ = oot_split(rows, "obs_date", ["row_id"])
    found = M.search_params(older, ["delay_days", "qty_sum", "status"], "obs_date", ["row_id"], M.BINARY, trials=2, rounds=2)
    assert len(found.trials) == 2 and found.best.value == min(t.value for t in found.trials)
    assert all(len(t.fold_losses) == 3 and not t.pruned for t in found.trials)
    again = M.draw_params(np.random.default_rng(M.SEED))
    assert found.trials[0].params == again
    assert found.as_table(spark).where("best").count() == 1


def test_pruning_rule():
    def trial(*losses):
        return M.Trial(0, {}, list(losses))

    earlier = [trial(0.5, 0.5, 0.5) for _ in range(5)]
    assert not M._falls_behind(trial(0.9), earlier)                 # first fold is a warm-up
    assert M._falls_behind(trial(0.9, 0.9), earlier)
    assert not M._falls_behind(trial(0.4, 0.4), earlier)
    assert not M._falls_behind(trial(0.9, 0.9), earlier[:4])        # too few finished trials


def test_trials_side_by_side_come_out_as_in_turn():
    rng = np.random.default_rng(2)
    losses = rng.uniform(0.3, 0.9, (20, 3)).tolist()
    in_turn = []
    for number, all_folds in enumerate(losses):
        trial = M.Trial(number, {})
        for k, loss in enumerate(all_folds, start=1):
            trial.fold_losses.append(loss)
            if k < 3 and M._falls_behind(trial, [t for t in in_turn if not t.pruned]):
                trial.pruned = True
                break
        in_turn.append(trial)
    assert any(t.pruned for t in in_turn)
    for width in (2, 6, 20):
        done = []
        for first in range(0, 20, width):
            some = [M.Trial(n, {}, list(losses[n])) for n in range(first, min(20, first + width))]
            done = M._as_if_in_turn(some, done)
        assert done == in_turn


def test_search_side_by_side_and_again(spark, sf, tmp_path, monkeypatch):
    """A search that breaks off goes on from its trial table, with the result of one in turn."""
    older, _ = oot_split(V.model_rows(spark, sf), "obs_date", ["row_id"])
    ask = lambda **more: M.search_params(older, ["delay_days", "status"], "obs_date", ["row_id"], M.BINARY, trials=3, rounds=1, **more)
    want = ask()
    path, add, lost = str(tmp_path / "trials"), M._TrialTable.add, []

    def break_off(table, trial, fold, loss):
        if (trial, fold) == (2, 2):
            raise RuntimeError("driver lost")
        add(table, trial, fold, loss)
        lost.append((trial, fold))

    monkeypatch.setattr(M._TrialTable, "add", break_off)
    with pytest.raises(RuntimeError, match="driver lost"):
        ask(parallel=3, path=path)
    fitted_again = []
    monkeypatch.setattr(M._TrialTable, "add", lambda table, *what: (fitted_again.append(what[:2]), add(table, *what)))
    found = ask(parallel=3, path=path)
    assert not set(fitted_again) & set(lost) and (2, 2) in fitted_again
    assert [t.params for t in found.trials] == [t.params for t in want.trials]
    for a, b in zip(found.trials, want.trials):
        assert a.fold_losses == pytest.approx(b.fold_losses, abs=1e-9)
    with pytest.raises(ValueError, match="another search"):
        M.search_params(older, ["delay_days"], "obs_date", ["row_id"], M.BINARY, trials=1, rounds=1, path=path)


def test_boosting_ends_early(spark, sf):
    older, _ = oot_split(V.model_rows(spark, sf), "obs_date", ["row_id"])
    order = ["obs_date", "row_id"]
    params = {**Q.PARAMS, "learning_rate": 0.5}
    stopped = M.train(older, ["delay_days", "qty_sum"], params, M.BINARY, 30, order=order, stop_share=0.2, stop_below=0.02)
    assert 1 <= stopped.model.getNumTrees < 30
    with pytest.raises(ValueError, match="date and tie"):
        M.train(older, ["delay_days"], params, M.BINARY, 2, stop_share=0.2)


def test_modes():
    with pytest.raises(ValueError):
        M.check_mode("ternary")
    assert M.depth_for(16) == 4 and M.depth_for(79) == 7 and M.depth_for(2) == 1


def test_positive_score_needs_two_classes(fitted):
    classifier, _ = fitted
    with pytest.raises(ValueError):
        A.make_explainer(None, M.Classifier(M.MULTI, classifier.matrix, classifier.model))


def test_training_rows_are_dealt_and_no_level_is_kept(spark, monkeypatch):
    """However few files a pass would be packed into, a task gets a bounded number of rows."""
    df = spark.range(0, 4000, 1, 2).select(
        "id", (F.col("id") * 7 % 100).cast("double").alias("x"), F.col("id").cast("double").alias("z"),
        (F.col("id") * 7 % 100 > 40).cast("int").alias("label"))
    params = {"learning_rate": 0.1, "num_leaves": 8, "min_child_samples": 5, "colsample_bytree": 1.0}
    seen, fit, dealt = [], M.GBTClassifier.fit, M.materialise_dealt
    monkeypatch.setattr(M, "materialise_dealt", lambda rows, n: seen.append(dealt(rows, 500)) or seen[-1])
    model = M.train(df, ["x", "z"], params, M.BINARY, rounds=2)
    sizes = [r["n"] for r in seen[0].groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 500
    estimator = M.build(M.BINARY, params, 2, 0)
    assert not estimator.getCacheNodeIds()
    kept = fit(estimator.setCacheNodeIds(True), seen[0])
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(kept) == trees(model.model)


def test_parts_of_a_tree_are_walked_once_for_the_columns_they_test(monkeypatch):
    rng = np.random.default_rng(6)
    slots = [0, 0, 1, 2, 3, 4, 5, 6, 7]

    def grow(depth):
        if depth == 0:
            return (float(rng.normal()),)
        slot = int(rng.integers(len(slots)))
        test = (None, [0.0, 2.0]) if slot == 2 else (float(rng.normal()), None)
        return (slot, *test, float(rng.uniform(0.2, 0.8)), grow(depth - 1), grow(depth - 1))

    def expected(node, x, coalition):
        if len(node) == 1:
            return node[0]
        slot, threshold, levels, share, left, right = node
        one, other = expected(left, x, coalition), expected(right, x, coalition)
        if coalition >> slots[slot] & 1:
            return plain(x[slot] <= threshold if levels is None else np.isin(x[slot], levels), one, other)
        return share * one + (1 - share) * other

    plain, calls = np.where, []
    tree, x = grow(6), rng.normal(size=(len(slots), 50))
    x[2] = rng.integers(0, 4, 50)
    monkeypatch.setattr(A.np, "where", lambda *a: calls.append(1) or plain(*a))
    mask, found = A.tree_worths(tree, x, slots)
    assert len(calls) < 63 * 256 / 2 / 3  # all columns for every split would be 63 * 128
    for s in range(256):
        assert np.array_equal(np.zeros(50) + found[s & mask], np.zeros(50) + expected(tree, x, s))


@pytest.fixture
def pools(monkeypatch):
    """How many fits each pool may run at once; every training table is written once."""
    widths, pool, tables, dealt = [], M.ThreadPoolExecutor, [], M.materialise_dealt
    monkeypatch.setattr(M, "ThreadPoolExecutor", lambda n: widths.append(n) or pool(n))
    monkeypatch.setattr(M, "materialise_dealt", lambda rows, n: tables[0] if tables else tables.append(dealt(rows, 500)) or tables[0])
    return widths


def _dated(spark):
    return spark.range(0, 3000, 1, 2).select(
        "id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("day"),
        (F.col("id") * 7 % 100).cast("double").alias("x"), (F.col("id") * 7 % 100 / 34).cast("int").alias("label"))


def test_classes_are_boosted_in_turn_where_one_keeps_all_cores_busy(spark, pools, monkeypatch):
    params = {"learning_rate": 0.1, "num_leaves": 8, "min_child_samples": 5, "colsample_bytree": 0.7}
    ask = lambda: M.train_boosted_classes(_dated(spark), ["x", "id"], params, ["day", "id"], rounds=3)
    beside = ask()
    monkeypatch.setattr(M, "ROWS_PER_TASK", 1)
    in_turn = ask()
    assert pools == [3, 1]
    trees = lambda m: [k.toDebugString.split("\n", 1)[1] for k in m.models]
    assert trees(beside) == trees(in_turn)


def test_trials_run_in_turn_where_one_keeps_all_cores_busy(spark, pools, monkeypatch):
    df = _dated(spark).withColumn("label", (F.col("label") > 0).cast("int"))
    ask = lambda: M.search_params(df, ["x", "id"], "day", ["id"], M.BINARY, trials=2, rounds=1, folds=2, parallel=2)
    beside = ask()
    assert pools == [2]
    monkeypatch.setattr(M, "ROWS_PER_TASK", 1)
    in_turn = ask()
    assert pools == [2]  # no other pool
    for a, b in zip(beside.trials, in_turn.trials):
        assert a.params == b.params and a.fold_losses == pytest.approx(b.fold_losses, abs=1e-9)


def test_patterns_of_leaves_are_worked_out_once_for_a_block(monkeypatch):
    """Not for every leaf, nor for every slice; leaves of more columns than a byte has bits take theirs apart."""
    rng = np.random.default_rng(7)

    def grow(depth, path, splits, leaves):
        if depth == 0:
            leaves.append(A._leaf(float(rng.normal()), path))
            return
        n, slot = len(splits), int(rng.integers(12))
        splits.append(A.Split(slot, float(rng.normal()), (0.0, 2.0) if slot == 2 else None))
        share = float(rng.uniform(0.2, 0.8))
        for left, part in ((True, share), (False, 1 - share)):
            grow(depth - 1, [*path, (slot, n, left, part)], splits, leaves)

    def plain(x, explainer):
        """Every leaf and row by itself: the Shapley sum over all coalitions of its other columns."""
        total = np.zeros((len(explainer.columns), len(x)))
        for tree in explainer.trees:
            for leaf in tree.leaves:
                d = len(leaf.players)
                passed = np.array([[all((r[tree.splits[n].slot] <= tree.splits[n].threshold if tree.splits[n].left_levels is None
                                         else r[tree.splits[n].slot] in tree.splits[n].left_levels) == side for n, side in tests)
                                    for tests in leaf.tests] for r in x], dtype=float)
                for i, player in enumerate(leaf.players):
                    others = [j for j in range(d) if j != i]
                    for size in range(d):
                        for known in itertools.combinations(others, size):
                            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                            worth = np.prod([passed[:, j] if j in known else np.full(len(x), leaf.cover[j]) for j in others], axis=0)
                            total[player] += leaf.value * weight * worth * (passed[:, i] - leaf.cover[i])
        return total

    trees = []
    for depth in (4, 5):
        splits, leaves = [], []
        grow(depth, [], splits, leaves)
        trees.append(A.Tree(tuple(splits), tuple(leaves)))
    long = [(i, i, True, 0.5) for i in range(10)]
    trees.append(A.Tree(tuple(A.Split(i, 0.5, None) for i in range(10)), (A._leaf(1.5, long),)))
    explainer = A.Explainer(tuple(f"c{i}" for i in range(12)), tuple(trees))
    x = rng.normal(size=(40, 12))
    x[:, 2] = rng.integers(0, 4, 40)
    calls, found = [], A.contributions
    monkeypatch.setattr(A, "contributions", lambda *a: calls.append(1) or found(*a))
    whole = A.attribute_block(x, explainer)
    assert np.allclose(whole, plain(x, explainer), atol=1e-12)
    assert len(calls) <= 4 + 5 + 1  # one for each number of columns and tree, one for the long leaf; 49 leaves
    monkeypatch.setattr(A, "SLICE_ROWS", 7)
    assert np.array_equal(A.attribute_block(x, explainer), whole)
