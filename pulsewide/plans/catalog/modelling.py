"""Model, attribution and counterfactual queries.

No SQL gives the same rows as a fitted model, so these have none; beside each stands
a ``_check`` query with what SQL knows about it. Parameters are the published ones but
for the rounds: ``ROUNDS`` are far fewer than the published 600, which the README lists with
the time those take; ``m2_stopped`` may take all 600, and the search makes all its trials and
rounds. The rows are always all rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.operators import attribute as A
from pulsewide.operators import counterfactual as X
from pulsewide.operators import evaluate as E
from pulsewide.operators import model as M
from pulsewide.operators import profile as P
from pulsewide.operators.matrix import LABEL, fit_matrix
from pulsewide.operators.split import oot_split
from pulsewide.plans import views as V
from pulsewide.plans.catalog.ingest import _OOT
from pulsewide.plans.catalog.registry import FEATURES, query, r, rounded
from pulsewide.session import materialise, scratch_path

COLUMNS = ["priority", "status", "total_price", "delay_days", "qty_sum", "disc_avg", "n_lines", V.FLAG]
PARAMS, PARAMS_MULTI = S.BEST_PARAMS_BINARY, S.BEST_PARAMS_MULTI
ROUNDS = 10
#: Rounds of the three-class models; at the published learning rate fewer change little.
THREE_ROUNDS = 60
#: What makes the three classes of the stand-in rows.
THREE_SCALES, THREE_CUTS = {"delay_days": 400.0, "qty_sum": 100.0, "total_price": 100000.0}, (2.2361, 3.6056)
#: Trials side by side, which changes no result, and the newest share of rows that ends boosting.
SEARCH_PARALLEL, STOP_SHARE = M.SEARCH_TRIALS, 0.2
INTERVENTION = [V.DELAY, V.FLAG]
KEY = ["row_id"]


def _split(spark, sf_dir):
    return oot_split(V.model_rows(spark, sf_dir), "obs_date", KEY)


@lru_cache(maxsize=8)
def _fitted(application: str, spark, sf_dir):
    """The binary model and its explainer, fitted once per application."""
    older, _ = _split(spark, sf_dir)
    classifier = M.train(older, COLUMNS, PARAMS, M.BINARY, ROUNDS)
    return classifier, A.make_explainer(spark, classifier)


def fitted(spark, sf_dir):
    return _fitted(spark.sparkContext.applicationId, spark, sf_dir)


def live(spark, sf_dir):
    """The newer rows without their label, active ones only."""
    _, newer = _split(spark, sf_dir)
    return newer.drop(LABEL).where(F.col(V.FLAG).isNotNull())


_LIVE = f"""{FEATURES}, {_OOT},
live AS (SELECT * FROM parted WHERE NOT is_train AND delay_days IS NOT NULL)"""


@query("k1_feature_matrix", f"""
WITH {FEATURES}, {_OOT},
low AS (SELECT min(delay_days) - 1 AS delay_days, min(qty_sum) - 1 AS qty_sum FROM parted WHERE is_train),
codes AS (
  SELECT status, CAST(row_number() OVER (ORDER BY n DESC, status) - 1 AS DOUBLE) AS code, count(*) OVER () AS known
  FROM (SELECT status, count(*) AS n FROM parted WHERE is_train GROUP BY status))
SELECT row_id, total_price AS s0,
       {r('coalesce(p.delay_days, low.delay_days)', 's1')}, CAST(p.delay_days IS NULL AS DOUBLE) AS s2,
       {r('coalesce(p.qty_sum, low.qty_sum)', 's3')}, CAST(p.qty_sum IS NULL AS DOUBLE) AS s4,
       coalesce(code, (SELECT any_value(known) FROM codes)) AS s5
FROM parted p CROSS JOIN low LEFT JOIN codes ON p.status = codes.status""")
def k1_feature_matrix(spark, sf_dir):
    """Model inputs of every row, with stand-ins and codes learned from the older rows."""
    older, _ = _split(spark, sf_dir)
    matrix = fit_matrix(older, ["total_price", "delay_days", "qty_sum", "status"])
    inputs = vector_to_array("features")
    rows = matrix.transform(V.model_rows(spark, sf_dir)).select("row_id", inputs.alias("x"))
    slots = rows.select("row_id", *[F.col("x")[i].alias(f"s{i}") for i in range(len(matrix.layout.slots))])
    return rounded(slots, "s1", "s3")


_WIDE_NAME = "CASE WHEN row_id % 11 <> 0 THEN 'c' || CAST(cust_id AS VARCHAR) END"


@query("k1_wide_text", f"""
WITH {FEATURES}, {_OOT},
named AS (
  SELECT *, coalesce('=' || {_WIDE_NAME}, '') AS level,
         CAST((coalesce(delay_days > 365, false) OR coalesce(qty_sum > 150, false)) <> (row_id * 48271 % 10 = 0) AS INTEGER) AS label
  FROM parted),
older AS (
  SELECT row_id, count(*) OVER before AS seen, coalesce(sum(label) OVER before, 0) AS ones FROM named WHERE is_train
  WINDOW before AS (PARTITION BY level ORDER BY obs_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT level, count(*) AS seen, sum(label) AS ones FROM named WHERE is_train GROUP BY level),
newer AS (
  SELECT row_id, coalesce(seen, 0) AS seen, coalesce(ones, 0) AS ones FROM named LEFT JOIN levels USING (level) WHERE NOT is_train)
SELECT row_id, total_price AS s0, {r('(ones + 0.5) / (seen + 1.0)', 's1')}
FROM named JOIN (SELECT * FROM older UNION ALL SELECT * FROM newer) USING (row_id)""")
def k1_wide_text(spark, sf_dir):
    """Model inputs with a text column of very many levels: older rows see what came before
    them, newer rows all older ones."""
    name = F.when(F.col("row_id") % 11 != 0, F.concat(F.lit("c"), F.col("cust_id").cast("string")))
    older, newer = oot_split(V.model_rows(spark, sf_dir).withColumn("name", name), "obs_date", KEY)
    matrix = fit_matrix(older, ["total_price", "name"], max_levels=5, label=LABEL)
    encoded = matrix.transform_training(older, LABEL, ["obs_date", *KEY]).unionByName(matrix.transform(newer))
    inputs = vector_to_array("features")
    return rounded(encoded.select("row_id", inputs[0].alias("s0"), inputs[1].alias("s1")), "s1")


@query("m2_gbt")
def m2_gbt(spark, sf_dir):
    classifier, _ = fitted(spark, sf_dir)
    _, newer = _split(spark, sf_dir)
    decided = classifier.predict(newer)
    return E.report(decided, LABEL, "prediction", classifier.codes)


_LABELLED = f"""{FEATURES}, {_OOT},
labelled AS (
  SELECT *, CAST((coalesce(delay_days > 365, false) OR coalesce(qty_sum > 150, false)) <> (row_id * 48271 % 10 = 0) AS INTEGER) AS label
  FROM parted)"""


@query("m2_gbt_check", f"""
WITH {_LABELLED}
SELECT CASE label WHEN 0 THEN 'Non-Detractor' ELSE 'Detractor' END AS class, count(*) AS support, true AS beats_naive
FROM labelled WHERE NOT is_train GROUP BY label""")
def m2_gbt_check(spark, sf_dir):
    """Support of each class, and whether the log-loss beats predicting the base rate."""
    classifier, _ = fitted(spark, sf_dir)
    _, newer = _split(spark, sf_dir)
    scored = materialise(classifier.score(newer).select(LABEL, F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")))
    loss = E.log_loss(scored, LABEL, ["p0", "p1"]).first()["logloss"]
    naive = P.base_rate(scored, LABEL, 2).first()["naive_logloss"]
    support = m2_gbt(spark, sf_dir).where(F.col("class").isin("Non-Detractor", "Detractor"))
    return support.select("class", "support", F.lit(loss < naive).alias("beats_naive"))


@lru_cache(maxsize=8)
def _stopped(application: str, spark, sf_dir):
    """The binary model of at most the published rounds, and its probabilities of the newer rows."""
    older, newer = _split(spark, sf_dir)
    classifier = M.train(older, COLUMNS, PARAMS, M.BINARY, M.FINAL_ROUNDS, order=["obs_date", *KEY], stop_share=STOP_SHARE)
    scored = classifier.score(newer).select("row_id", LABEL, F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))
    return classifier, materialise(scored)


@query("m2_stopped")
def m2_stopped(spark, sf_dir):
    """Log-loss on the newer rows of boosting that may take all published rounds and ends
    when the newest older rows gain nothing more."""
    classifier, scored = _stopped(spark.sparkContext.applicationId, spark, sf_dir)
    return E.log_loss(scored, LABEL, ["p0", "p1"]).withColumn("rounds", F.lit(classifier.model.getNumTrees))


@query("m2_stopped_check", f"""
WITH {_LABELLED} SELECT label, count(*) AS n, true AS within, true AS beats FROM labelled WHERE NOT is_train GROUP BY label""")
def m2_stopped_check(spark, sf_dir):
    """Rows of each class, whether the rounds lie within the published ones, and whether the
    log-loss beats predicting the base rate."""
    classifier, scored = _stopped(spark.sparkContext.applicationId, spark, sf_dir)
    naive = P.base_rate(scored, LABEL, 2).first()["naive_logloss"]
    loss = E.log_loss(scored, LABEL, ["p0", "p1"]).first()["logloss"]
    return scored.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "within": F.lit(1 <= classifier.model.getNumTrees <= M.FINAL_ROUNDS), "beats": F.lit(loss < naive)})


@query("k2_saved_scores", f"""
WITH {_LABELLED} SELECT count(*) AS n, CAST(0 AS DOUBLE) AS largest_gap, true AS same_columns FROM labelled WHERE NOT is_train""")
def k2_saved_scores(spark, sf_dir):
    """Scores before and after the model is saved and loaded."""
    classifier, _ = fitted(spark, sf_dir)
    path = scratch_path(spark)
    classifier.save(spark, path)
    loaded = M.Classifier.load(spark, path)
    _, newer = _split(spark, sf_dir)
    both = loaded.score_positive(classifier.score_positive(newer, "before"), "after")
    same = loaded.matrix.layout == classifier.matrix.layout
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_gap"), F.lit(same).alias("same_columns"))


def _three_classes(spark, sf_dir):
    """Older and newer rows of three classes by a sum of delay, quantity and price, of which
    every tenth is moved on by one."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) / F.lit(scale) for c, scale in THREE_SCALES.items()), F.lit(0.0))
    kind = F.when(total < THREE_CUTS[0], 0).when(total < THREE_CUTS[1], 1).otherwise(2)
    moved = (F.col("row_id") * 48271 % 10 == 0).cast("int")
    rows = V.model_rows(spark, sf_dir).withColumn(LABEL, ((kind + moved) % 3).cast("int"))
    return oot_split(rows, "obs_date", KEY)


@lru_cache(maxsize=8)
def _three_fitted(application: str, kind: str, spark, sf_dir):
    """A three-class model and the written class probabilities of the newer rows."""
    older, newer = _three_classes(spark, sf_dir)
    if kind == "boost":
        classifier = M.train_boosted_classes(older, COLUMNS, PARAMS_MULTI, ["obs_date", *KEY], THREE_ROUNDS)
    else:
        classifier = M.train(older, COLUMNS, PARAMS_MULTI, M.MULTI, ROUNDS)
    return classifier, materialise(classifier.score(newer).select("row_id", LABEL, "p"))


def _three(kind, spark, sf_dir):
    return _three_fitted(spark.sparkContext.applicationId, kind, spark, sf_dir)


def _multi_loss(kind, spark, sf_dir) -> float:
    _, scored = _three(kind, spark, sf_dir)
    spread = scored.select(LABEL, *[F.col("p")[k].alias(f"p{k}") for k in range(3)])
    return E.log_loss(spread, LABEL, ["p0", "p1", "p2"]).first()["logloss"]


@query("m3_rf")
def m3_rf(spark, sf_dir):
    """Summary of the expected score by the forest."""
    classifier, scored = _three("forest", spark, sf_dir)
    return P.score_summary(E.with_expected_score(scored, "p", classifier.codes), "expected_score")


@query("m3_boost")
def m3_boost(spark, sf_dir):
    """Summary of the expected score by boosting, one class against the rest."""
    classifier, scored = _three("boost", spark, sf_dir)
    return P.score_summary(E.with_expected_score(scored, "p", classifier.codes), "expected_score")


_TOTAL = "(" + " + ".join(f"coalesce({c}, 0) / CAST({scale} AS DOUBLE)" for c, scale in THREE_SCALES.items()) + ")"
_THREE = f"""{FEATURES}, {_OOT},
three AS (
  SELECT CAST((CASE WHEN {_TOTAL} < {THREE_CUTS[0]} THEN 0 WHEN {_TOTAL} < {THREE_CUTS[1]} THEN 1 ELSE 2 END
               + CASE WHEN row_id * 48271 % 10 = 0 THEN 1 ELSE 0 END) % 3 AS INTEGER) AS label FROM parted WHERE NOT is_train)"""


def _three_check(kind, spark, sf_dir, better):
    _, scored = _three(kind, spark, sf_dir)
    whole = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    return scored.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~whole | (F.size("p") != 3) | (F.array_min("p") < 0)).alias("n_odd")
    ).withColumn("beats", F.lit(better))


@query("m3_rf_check", f"""
WITH {_THREE} SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS n_odd, true AS beats FROM three GROUP BY label""")
def m3_rf_check(spark, sf_dir):
    """Rows of each class on the newer side, probabilities that are none, and whether the
    forest's log-loss is below that of three equal chances. Which of the two models is better
    depends on the number of rows: see the README."""
    return _three_check("forest", spark, sf_dir, _multi_loss("forest", spark, sf_dir) < math.log(3))


@query("m3_boost_check", f"""
WITH {_THREE} SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS n_odd, true AS beats FROM three GROUP BY label""")
def m3_boost_check(spark, sf_dir):
    """The same for boosting."""
    return _three_check("boost", spark, sf_dir, _multi_loss("boost", spark, sf_dir) < math.log(3))


@lru_cache(maxsize=8)
def _searched(application: str, spark, sf_dir):
    """The search over all published trials, rounds and folds, made once per application."""
    older, _ = _split(spark, sf_dir)
    return M.search_params(older, COLUMNS, "obs_date", KEY, M.BINARY, parallel=SEARCH_PARALLEL)


@query("m4_search")
def m4_search(spark, sf_dir):
    return _searched(spark.sparkContext.applicationId, spark, sf_dir).as_table(spark)


@query("m4_search_check", f"""
SELECT CAST({M.SEARCH_TRIALS} AS BIGINT) AS n_trials, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_odd_folds,
       CAST(1 AS BIGINT) AS n_best, true AS best_is_least""")
def m4_search_check(spark, sf_dir):
    """Drawn parameters lie in the published ranges, unpruned trials ran all folds, and the best has the least loss."""
    t = m4_search(spark, sf_dir)
    inside = (
        F.col("learning_rate").between(*M.LEARNING_RATE_RANGE) & F.col("num_leaves").between(*M.LEAVES_RANGE)
        & F.col("min_child_samples").between(*M.MIN_CHILD_RANGE) & F.col("colsample_bytree").between(*M.COLSAMPLE_RANGE)
    )
    folds = F.col("folds")
    odd = F.when(F.col("pruned"), ~folds.between(M.PRUNE_AFTER_FOLDS + 1, M.SEARCH_FOLDS)).otherwise(folds != M.SEARCH_FOLDS)
    return t.agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(~inside).alias("n_outside"), F.count_if(odd).alias("n_odd_folds"),
        F.count_if("best").alias("n_best"),
        (F.min(F.when(F.col("best"), F.col("logloss"))) == F.min(F.when(~F.col("pruned"), F.col("logloss")))).alias("best_is_least"),
    )


@query("m6_live_score")
def m6_live_score(spark, sf_dir):
    classifier, _ = fitted(spark, sf_dir)
    return classifier.score_positive(live(spark, sf_dir)).select("row_id", "p")


@query("m6_live_coverage", f"""
WITH {_LIVE} SELECT count(*) AS n_scored, CAST(0 AS BIGINT) AS n_outside FROM live""")
def m6_live_coverage(spark, sf_dir):
    """Every active Live row gets a probability; no row cap."""
    p = F.col("p")
    return m6_live_score(spark, sf_dir).agg(
        F.count("p").alias("n_scored"), F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("n_outside")
    )


@query("e4_model_threshold")
def e4_model_threshold(spark, sf_dir):
    classifier, _ = fitted(spark, sf_dir)
    _, newer = _split(spark, sf_dir)
    scored = materialise(classifier.score_positive(newer).select(LABEL, "p"))
    return E.best_threshold(scored, LABEL, "p", 2.0)


@query("e4_model_threshold_check", "SELECT true AS recomputed, true AS is_best")
def e4_model_threshold_check(spark, sf_dir):
    """The curve's best row against counts taken directly at its threshold and at every percent."""
    classifier, _ = fitted(spark, sf_dir)
    _, newer = _split(spark, sf_dir)
    scored = materialise(classifier.score_positive(newer).select(LABEL, "p"))
    best = E.best_threshold(scored, LABEL, "p", 2.0).first()
    cuts = [best["threshold"], *[i / 100 for i in range(1, 100)]]
    y = F.col(LABEL) == 1
    one = scored.agg(
        F.count_if(y).alias("true"),
        *[F.count_if(F.col("p") >= F.lit(c)).alias(f"n{i}") for i, c in enumerate(cuts)],
        *[F.count_if(y & (F.col("p") >= F.lit(c))).alias(f"t{i}") for i, c in enumerate(cuts)],
    ).first()

    def fbeta(i: int) -> float:
        precision, recall = one[f"t{i}"] / max(one[f"n{i}"], 1), one[f"t{i}"] / one["true"]
        return 5 * precision * recall / max(4 * precision + recall, 1e-12)

    again = abs(fbeta(0) - best["fbeta"]) < 1e-9
    return spark.createDataFrame([(again, fbeta(0) >= max(fbeta(i) for i in range(1, len(cuts))) - 1e-12)], "recomputed boolean, is_best boolean")


def _attributed(spark, sf_dir, keep=("row_id",)):
    classifier, explainer = fitted(spark, sf_dir)
    return A.attribute(live(spark, sf_dir), classifier, explainer, list(keep)), explainer


@query("x1_shap")
def x1_shap(spark, sf_dir):
    attributed, explainer = _attributed(spark, sf_dir)
    return A.long_attributions(attributed, explainer, KEY)


@query("x1_local_accuracy", f"""
WITH {_LIVE} SELECT count(*) AS n, CAST(0 AS DOUBLE) AS largest_gap FROM live""")
def x1_local_accuracy(spark, sf_dir):
    """Base value plus contributions against the scored log-odds, over all Live rows."""
    classifier, explainer = fitted(spark, sf_dir)
    scored = classifier.score_positive(live(spark, sf_dir))
    attributed = A.attribute(scored.drop("p"), classifier, explainer, KEY)
    total = F.aggregate("shap", F.lit(explainer.base_value), lambda acc, x: acc + x)
    logit = F.ln(F.col("p") / (1 - F.col("p")))
    both = attributed.join(scored.select("row_id", "p"), "row_id")
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(total - logit)).alias("largest_gap")), "largest_gap")


@query("x1_shap_check", f"""
WITH {_LIVE}
SELECT unnest([{", ".join(f"'{c}'" for c in COLUMNS)}]) AS feature, (SELECT count(*) FROM live) AS n,
       CAST(0 AS DOUBLE) AS largest_gap, CAST(0 AS DOUBLE) AS importance_gap""")
def x1_shap_check(spark, sf_dir):
    """Every contribution of every Live row against the enumeration of all coalitions, and
    each column's importance from either."""
    classifier, explainer = fitted(spark, sf_dir)
    rows = live(spark, sf_dir)
    both = A.attribute(rows, classifier, explainer, KEY).join(
        A.attribute_by_enumeration(rows, classifier, KEY, "listed"), KEY)
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(A.SHAP)[i].alias("one"), F.col("listed")[i].alias("other"))
        for i, c in enumerate(explainer.columns)
    ])
    gap = F.abs(F.avg(F.abs(F.col("one"))) - F.avg(F.abs(F.col("other"))))
    found = both.select(F.inline(cells)).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("one") - F.col("other"))).alias("largest_gap"), gap.alias("importance_gap"))
    return rounded(found, "largest_gap", "importance_gap")


@query("x3_importance")
def x3_importance(spark, sf_dir):
    return A.top_importance(*_attributed(spark, sf_dir), k=15)


@query("x3_importance_check", "SELECT unnest([" + ", ".join(f"'{c}'" for c in COLUMNS) + "]) AS feature, true AS is_finite")
def x3_importance_check(spark, sf_dir):
    """Every model column is ranked, with a finite importance that is not negative."""
    return x3_importance(spark, sf_dir).select("feature", ((F.col("mean_abs_shap") >= 0) & (F.col("mean_abs_shap") < 1e9)).alias("is_finite"))


_RANGES = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), "
    f"[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM live) AS edges FROM live"
    for c in ("delay_days", "qty_sum", "total_price"))


@query("x4_directional_check", f"""
WITH {_LIVE}, cells AS ({_RANGES}),
placed AS (SELECT feature, v, CASE WHEN v IS NOT NULL THEN CAST(len(list_filter(edges, lambda e: e < v)) AS INTEGER) END AS value_range FROM cells)
SELECT feature, value_range, count(*) AS n, {r('min(v)', 'value_min')}, {r('max(v)', 'value_max')}, true AS ordered
FROM placed GROUP BY feature, value_range""")
def x4_directional_check(spark, sf_dir):
    """Counts and value bounds of every range; the mean contribution lies between its extremes."""
    between = (F.col("mean_shap") >= F.col("min_shap") - 1e-9) & (F.col("mean_shap") <= F.col("max_shap") + 1e-9)
    return rounded(x4_directional(spark, sf_dir).select(
        "feature", "value_range", "n", "value_min", "value_max", between.alias("ordered")), "value_min", "value_max")


@query("x4_directional")
def x4_directional(spark, sf_dir):
    features = ["delay_days", "qty_sum", "total_price"]
    attributed, explainer = _attributed(spark, sf_dir, ("row_id", *features))
    return A.directional(materialise(attributed), explainer, features)


@query("x4_points")
def x4_points(spark, sf_dir):
    """A sample of points for a scatter: a sampling operator, so it returns part of the rows."""
    features = ["delay_days", "qty_sum"]
    attributed, explainer = _attributed(spark, sf_dir, ("row_id", *features))
    return A.points(materialise(attributed), explainer, KEY, features, 500)


@query("x5_waterfall")
def x5_waterfall(spark, sf_dir):
    """Contributions of the row with the highest score."""
    classifier, explainer = fitted(spark, sf_dir)
    rows = live(spark, sf_dir)
    top = P.extremes(classifier.score_positive(rows), "p", "row_id").where("who = 'high'").first()
    one = rows.where(F.col("row_id") == top["row_id"])
    return A.waterfall(A.attribute(one, classifier, explainer, KEY), explainer, "row_id", top["row_id"])


@query("x5_waterfall_check", f"""
SELECT CAST({len(COLUMNS)} AS BIGINT) AS n_steps, CAST(0 AS DOUBLE) AS largest_break, true AS ends_at_score, true AS by_size, true AS text_id""")
def x5_waterfall_check(spark, sf_dir):
    """Steps join up, go by size, and end at the row's log-odds; the row has a text id."""
    classifier, explainer = fitted(spark, sf_dir)
    rows = live(spark, sf_dir).withColumn("name", F.concat(F.lit("row "), "row_id"))
    top = P.extremes(classifier.score_positive(rows), "p", "name").where("who = 'high'").first()
    one = rows.where(F.col("name") == top["name"])
    steps = A.waterfall(A.attribute(one, classifier, explainer, ["name"]), explainer, "name", top["name"])
    found = sorted(steps.collect(), key=lambda s: s["rank"])
    joints = [explainer.base_value, *[s["to_logodds"] for s in found]]
    breaks = max(abs(a - s["from_logodds"]) for a, s in zip(joints, found))
    logit = math.log(top["p"] / (1 - top["p"]))
    sizes = [abs(s["shap"]) for s in found]
    out = [(len(found), round(breaks, 6), abs(joints[-1] - logit) < 1e-6, sizes == sorted(sizes, reverse=True), steps.schema["name"].dataType.simpleString() == "string")]
    return spark.createDataFrame(out, "n_steps bigint, largest_break double, ends_at_score boolean, by_size boolean, text_id boolean")


@query("x6_counterfactual_check", f"""
WITH {_LIVE} SELECT count(*) AS n, CAST(0 AS DOUBLE) AS gap, true AS in_range FROM live""")
def x6_counterfactual_check(spark, sf_dir):
    """The effect is the difference of the rates, which are probabilities, over all Live rows."""
    found = x6_counterfactual(spark, sf_dir)
    gap = F.abs(F.col("ate") - (F.col("baseline_rate") - F.col("cf_rate")))
    inside = F.col("baseline_rate").between(0, 1) & F.col("cf_rate").between(0, 1)
    return rounded(found.select("n", gap.alias("gap"), inside.alias("in_range")), "gap")


@query("x6_counterfactual")
def x6_counterfactual(spark, sf_dir):
    classifier, _ = fitted(spark, sf_dir)
    return X.rates(live(spark, sf_dir), INTERVENTION, classifier)


@query("x6_empty_intervention", f"""
WITH {_LIVE} SELECT count(*) AS n, CAST(0 AS DOUBLE) AS ate, CAST(0 AS DOUBLE) AS relative_reduction FROM live""")
def x6_empty_intervention(spark, sf_dir):
    """Changing nothing has no effect."""
    classifier, _ = fitted(spark, sf_dir)
    return X.rates(live(spark, sf_dir), [], classifier).select("n", "ate", "relative_reduction")


@query("x8_new_lever")
def x8_new_lever(spark, sf_dir):
    classifier, explainer = fitted(spark, sf_dir)
    rows = live(spark, sf_dir)
    outcome = X.simulate(rows, classifier, explainer, INTERVENTION, KEY)
    before = A.attribute(rows, classifier, explainer, KEY)
    return X.new_lever(before, outcome.attributed, explainer, V.DELAY, INTERVENTION)


@query("x8_new_lever_check", f"""
SELECT '{V.DELAY}' AS lever, true AS is_column, false AS is_intervened, true AS is_strongest""")
def x8_new_lever_check(spark, sf_dir):
    """The next lever is a column outside the intervention, with the largest importance among those."""
    classifier, explainer = fitted(spark, sf_dir)
    found = x8_new_lever(spark, sf_dir).first()
    outcome = X.simulate(live(spark, sf_dir), classifier, explainer, INTERVENTION, KEY)
    sizes = {r["feature"]: r["mean_abs_shap"] for r in A.importance(outcome.attributed, explainer).collect()}
    strongest = max(v for k, v in sizes.items() if k not in INTERVENTION)
    out = [(found["lever"], found["new_lever"] in COLUMNS, found["new_lever"] in INTERVENTION, abs(found["new_mean_abs_shap"] - strongest) < 1e-9)]
    return spark.createDataFrame(out, "lever string, is_column boolean, is_intervened boolean, is_strongest boolean")


@query("x9_exemplars_check", "SELECT unnest(['high', 'low']) AS who, true AS is_extreme")
def x9_exemplars_check(spark, sf_dir):
    """The two rows have the largest and the smallest score of all Live rows."""
    bounds = m6_live_score(spark, sf_dir).agg(F.max("p").alias("high"), F.min("p").alias("low")).first()
    want = F.when(F.col("who") == "high", F.lit(bounds["high"])).otherwise(F.lit(bounds["low"]))
    return x9_exemplars(spark, sf_dir).select("who", (F.abs(F.col("p") - want) < 1e-12).alias("is_extreme"))


@query("x9_exemplars")
def x9_exemplars(spark, sf_dir):
    classifier, _ = fitted(spark, sf_dir)
    return P.extremes(classifier.score_positive(live(spark, sf_dir)), "p", "row_id")
