"""Classifier training, the temporal parameter search, and saved state.

The published analysis boosts trees leaf by leaf; MLlib grows them level by
level. A leaf budget becomes the depth that can hold it, and the per-tree column
share becomes MLlib's per-node share.
"""

from __future__ import annotations

import json
import math
import statistics
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.operators import boosting as B
from pulsewide.operators.evaluate import _EPS, class_weights, log_loss
from pulsewide.operators.matrix import FEATURES, LABEL, Matrix, fit_matrix
from pulsewide.operators.split import expanding_folds, oot_mark
from pulsewide.session import materialise_dealt, scratch_path, shared_dir

BINARY, MULTI = "binary", "multi"
PROBABILITY = "p"
WEIGHT = "weight"
# fixed values: search ranges and budgets of the published protocol
LEARNING_RATE_RANGE = (0.01, 0.1)
LEAVES_RANGE = (20, 100)
MIN_CHILD_RANGE = (20, 200)
COLSAMPLE_RANGE = (0.6, 1.0)
SEARCH_TRIALS, SEARCH_ROUNDS, SEARCH_FOLDS = 20, 400, 3
PRUNE_AFTER_TRIALS, PRUNE_AFTER_FOLDS = 5, 1
FINAL_ROUNDS, SEED = 600, 42
#: Newest rows that grow no tree, as :func:`train_boosted_classes` and early stops use them.
_LATE = "__late"
#: Gain of a round, as a fraction of the loss, below which boosting may end early.
STOP_BELOW = 1e-3
#: Training rows that a task holds in memory at most.
ROWS_PER_TASK = 250_000
#: Rows in bins that take no more memory than one of MLlib's: about 20 bytes each.
BINNED = 10
#: Rows of a search, as codes of a few bytes, that one task boosts on by itself at most.
ROWS_PER_FIT = 1_000_000


def check_mode(mode: str) -> None:
    if mode not in (BINARY, MULTI):
        raise ValueError(f"mode must be '{BINARY}' or '{MULTI}'; got {mode!r}")


def codes_of(mode: str) -> list[int]:
    check_mode(mode)
    return [0, 1] if mode == BINARY else list(S.CLASS_CODES)


def with_balanced_weight(df: DataFrame, label: str = LABEL, name: str = WEIGHT) -> DataFrame:
    """Add the balanced class weight; the weights are one number per class."""
    weight = F.lit(1.0)
    for row in class_weights(df, label).collect():
        weight = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(weight)
    return df.withColumn(name, weight)


def depth_for(leaves: int) -> int:
    return max(1, math.ceil(math.log2(leaves)))


def build(mode: str, params: Mapping[str, float], rounds: int, max_levels: int, seed: int = SEED):
    """Estimator for a mode: boosted trees for two classes, a forest for three."""
    check_mode(mode)
    common = dict(
        featuresCol=FEATURES,
        labelCol=LABEL,
        maxDepth=depth_for(int(params["num_leaves"])),
        minInstancesPerNode=int(params["min_child_samples"]),
        featureSubsetStrategy=str(float(params["colsample_bytree"])),
        maxBins=max(64, max_levels + 2),
        seed=seed,
        # trees are shallow: walking them costs less than a table of nodes for every level
        cacheNodeIds=False,
        checkpointInterval=10,
    )
    if mode == BINARY:
        return GBTClassifier(
            maxIter=rounds, stepSize=float(params["learning_rate"]), weightCol=WEIGHT, **common
        )
    return RandomForestClassifier(numTrees=rounds, **common)


@dataclass(frozen=True)
class Classifier:
    """A fitted matrix and model; scoring is a narrow transform of each row."""

    mode: str
    matrix: Matrix
    model: GBTClassificationModel | RandomForestClassificationModel

    @property
    def codes(self) -> list[int]:
        return list(range(self.model.numClasses))

    def score(self, df: DataFrame, name: str = PROBABILITY, keep_features: bool = False) -> DataFrame:
        """Add the array of class probabilities."""
        out = self.model.transform(self.matrix.transform(df))
        scored = out.withColumn(name, vector_to_array("probability"))
        extra = ["rawPrediction", "probability", "prediction"]
        return scored.drop(*extra, *([] if keep_features else [FEATURES]))

    def score_positive(self, df: DataFrame, name: str = PROBABILITY) -> DataFrame:
        """Add the probability of the positive class of a binary model."""
        if len(self.codes) != 2:
            raise ValueError(f"a binary model is needed; got classes {self.codes}")
        return self.score(df, name).withColumn(name, F.col(name)[1])

    def predict(self, df: DataFrame, threshold: float = 0.5, name: str = "prediction") -> DataFrame:
        """Add the decided class: by threshold for two classes, the likeliest for more."""
        scored = self.score(df, "__p")
        if len(self.codes) == 2:
            decided = (F.col("__p")[1] >= threshold).cast("int")
        else:
            decided = (F.array_position("__p", F.array_max("__p")) - 1).cast("int")
        return scored.withColumn(name, decided).drop("__p")

    def save(self, spark: SparkSession, path: str) -> None:
        self.matrix.save(spark, path + "/matrix")
        self.model.write().overwrite().save(path + "/model")
        row = spark.createDataFrame([(json.dumps({"mode": self.mode}),)], "state string")
        row.coalesce(1).write.mode("overwrite").parquet(path + "/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        mode = json.loads(spark.read.parquet(path + "/state").first()["state"])["mode"]
        kind = GBTClassificationModel if mode == BINARY else RandomForestClassificationModel
        return Classifier(mode, Matrix.load(spark, path + "/matrix"), kind.load(path + "/model"))


def _side_by_side(ready: DataFrame, wanted: int, n: int | None = None) -> int:
    """How many of ``wanted`` fits run at once: all, or one where it has tasks for every core.

    A fit holds its rows in memory, in bins. Where one keeps all cores busy, more beside it
    gain no time and hold as many times the rows. ``n`` is the number of rows, if it is known.
    """
    cores = ready.sparkSession.sparkContext.defaultParallelism
    return wanted if (ready.count() if n is None else n) < ROWS_PER_TASK * BINNED * cores else 1


def _training_rows(matrix: Matrix, df: DataFrame, order: Sequence[str]) -> DataFrame:
    if matrix.wide and not order:
        hashed = df.withColumn("__order", F.xxhash64(*[F.col(c) for c in matrix.layout.columns]))
        return matrix.transform_training(hashed, LABEL, ["__order"])
    return matrix.transform_training(df, LABEL, order)


def train(
    df: DataFrame,
    columns: Sequence[str],
    params: Mapping[str, float],
    mode: str = MULTI,
    rounds: int = FINAL_ROUNDS,
    seed: int = SEED,
    order: Sequence[str] = (),
    stop_share: float | None = None,
    stop_below: float = STOP_BELOW,
) -> Classifier:
    """Fit the final classifier on a table with a ``label`` column.

    With ``stop_share`` boosting ends early: that newest share of the rows by ``order``
    grows no tree, and once a round betters its loss by less than the fraction
    ``stop_below``, the rounds up to the best one are kept; ``rounds`` is then the most.

    Two classes are weighted to balance; three are not, which keeps their
    probabilities usable as such. The assembled matrix is written once to the
    shared folder, because every boosting round reads it. ``order`` names the date and
    tie columns that text columns of very many levels are encoded along; without it rows
    are taken in the order of a hash.
    """
    check_mode(mode)
    shared_dir(df.sparkSession)
    if stop_share is not None and (mode != BINARY or not order):
        raise ValueError("ending early needs two classes and the date and tie columns of the rows")
    matrix = fit_matrix(df, columns, label=LABEL, classes=codes_of(mode))
    kept = [F.col(LABEL).cast("double").alias(LABEL), FEATURES]
    if stop_share is None:
        rows = _training_rows(matrix, df, order)
    else:
        date_col, *tie = order
        rows = _training_rows(matrix, oot_mark(df, date_col, tie, stop_share, "__early"), order)
        kept.append((~F.col("__early")).alias(_LATE))
    ready = rows.select(*kept)
    if mode == BINARY:
        ready = with_balanced_weight(ready)
    estimator = build(mode, params, rounds, matrix.layout.max_levels, seed)
    if stop_share is not None:
        estimator.setValidationIndicatorCol(_LATE)
        estimator.set(estimator.validationTol, stop_below)
    return Classifier(mode, matrix, estimator.fit(materialise_dealt(ready, ROWS_PER_TASK)))


# --- boosting for three classes ------------------------------------------------------

_MARGINS = "__margins"
#: Newest share of the training rows that decides the calibration and grows no tree.
CALIBRATION_SHARE = 0.2


@dataclass(frozen=True)
class BoostedClasses:
    """One boosted model for each class against the rest, and what makes their margins
    probabilities that add up to one. Scoring is a narrow transform of each row."""

    matrix: Matrix
    models: tuple[GBTClassificationModel, ...]
    calibration: LogisticRegressionModel

    @property
    def codes(self) -> list[int]:
        return list(range(len(self.models)))

    def score(self, df: DataFrame, name: str = PROBABILITY, keep_features: bool = False) -> DataFrame:
        """Add the array of class probabilities."""
        held = _with_margins(self.matrix.transform(df), self.models)
        out = self.calibration.transform(held).withColumn(name, vector_to_array("probability"))
        extra = ["rawPrediction", "probability", "prediction", _MARGINS]
        return out.drop(*extra, *([] if keep_features else [FEATURES]))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the likeliest class."""
        scored = self.score(df, "__p")
        return scored.withColumn(name, (F.array_position("__p", F.array_max("__p")) - 1).cast("int")).drop("__p")

    def save(self, spark: SparkSession, path: str) -> None:
        self.matrix.save(spark, path + "/matrix")
        for code, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/class/{code}")
        self.calibration.write().overwrite().save(path + "/calibration")
        row = spark.createDataFrame([(json.dumps({"classes": len(self.models)}),)], "state string")
        row.coalesce(1).write.mode("overwrite").parquet(path + "/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedClasses:
        n = json.loads(spark.read.parquet(path + "/state").first()["state"])["classes"]
        models = tuple(GBTClassificationModel.load(f"{path}/class/{code}") for code in range(n))
        return BoostedClasses(Matrix.load(spark, path + "/matrix"), models, LogisticRegressionModel.load(path + "/calibration"))


def _with_margins(df: DataFrame, models: Sequence[GBTClassificationModel]) -> DataFrame:
    """Add the vector of the models' log-odds."""
    for code, model in enumerate(models):
        raw = f"__raw_{code}"
        model.setRawPredictionCol(raw).setProbabilityCol(f"__probability_{code}").setPredictionCol(f"__decided_{code}")
        df = model.transform(df).drop(f"__probability_{code}", f"__decided_{code}")
    raws = [f"__raw_{code}" for code in range(len(models))]
    return df.withColumn(_MARGINS, array_to_vector(F.array(*[vector_to_array(r)[1] for r in raws]))).drop(*raws)


def train_boosted_classes(
    df: DataFrame,
    columns: Sequence[str],
    params: Mapping[str, float],
    order: Sequence[str],
    rounds: int = FINAL_ROUNDS,
    seed: int = SEED,
    calibration_share: float = CALIBRATION_SHARE,
) -> BoostedClasses:
    """Boost each class of ``label`` against the rest and couple the results.

    All models read one matrix, which is written once, and are fitted side by side, or in
    turn where one alone keeps all cores busy. Trees grow on the older rows; on the newest,
    by ``order`` (a date and ties), a multinomial regression of the class on the margins
    gives calibrated probabilities. It sees one row more for each class, so a class that is
    absent there stays possible.
    """
    spark = df.sparkSession
    shared_dir(spark)
    codes = codes_of(MULTI)
    date_col, *tie = order
    matrix = fit_matrix(df, columns, label=LABEL, classes=codes)
    marked = oot_mark(df, date_col, tie, calibration_share, "__early")
    rows = matrix.transform_training(marked, LABEL, order)
    ready = materialise_dealt(
        rows.select(F.col(LABEL).cast("double").alias(LABEL), FEATURES, (~F.col("__early")).alias(_LATE)), ROWS_PER_TASK)

    def estimator_of() -> GBTClassifier:
        estimator = build(BINARY, params, rounds, matrix.layout.max_levels, seed)
        estimator.clear(estimator.weightCol)  # balanced weights would shift the probabilities
        return estimator

    # cut points do not depend on the class that is told from the rest
    early = ready.where(~F.col(_LATE))
    found = B.find_binning(early.select((F.col(LABEL) == codes[0]).cast("double").alias(LABEL), FEATURES), estimator_of())
    rows = B.packed(early, found, LABEL, FEATURES)

    @inheritable_thread_target(spark)
    def fit(code: int) -> GBTClassificationModel:
        # a pool of its own, where the cluster schedules fairly
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"class {code}")
        estimator = estimator_of()
        one = rows.map(lambda r: (r[0], (r[1] == code).astype(np.int8), r[2]))
        trees, _ = B.boost(found, B.settings_of(estimator, found), one)
        return B.to_model(spark, estimator, trees)

    with ThreadPoolExecutor(_side_by_side(ready, len(codes))) as pool:
        models = tuple(pool.map(fit, codes))
    late = _with_margins(ready.where(_LATE), models).select(LABEL, _MARGINS)
    anchors = ready.sparkSession.createDataFrame(
        [(float(c), [1.0 if k == c else -1.0 for k in codes]) for c in codes], "label double, m array<double>"
    ).select(F.col("label").alias(LABEL), array_to_vector("m").alias(_MARGINS))
    regression = LogisticRegression(family="multinomial", featuresCol=_MARGINS, labelCol=LABEL, regParam=1e-5)
    margins = scratch_path(spark)
    late.unionByName(anchors).write.parquet(margins)
    return BoostedClasses(matrix, models, regression.fit(spark.read.parquet(margins)))


# --- parameter search -----------------------------------------------------------


@dataclass
class Trial:
    number: int
    params: dict[str, float]
    fold_losses: list[float] = field(default_factory=list)
    pruned: bool = False

    def running(self, folds: int) -> float:
        return statistics.fmean(self.fold_losses[:folds])

    @property
    def value(self) -> float:
        return self.running(len(self.fold_losses))


@dataclass(frozen=True)
class Search:
    trials: list[Trial]

    @property
    def best(self) -> Trial:
        return min((t for t in self.trials if not t.pruned), key=lambda t: t.value)

    def as_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t.number, t.params["learning_rate"], t.params["num_leaves"],
             t.params["min_child_samples"], t.params["colsample_bytree"],
             len(t.fold_losses), t.value, t.pruned, t is self.best)
            for t in self.trials
        ]
        return spark.createDataFrame(
            rows,
            "trial int, learning_rate double, num_leaves int, min_child_samples int, "
            "colsample_bytree double, folds int, logloss double, pruned boolean, best boolean",
        )


def draw_params(rng: np.random.Generator) -> dict[str, float]:
    lo, hi = (math.log(x) for x in LEARNING_RATE_RANGE)
    return {
        "learning_rate": float(math.exp(rng.uniform(lo, hi))),
        "num_leaves": int(rng.integers(LEAVES_RANGE[0], LEAVES_RANGE[1], endpoint=True)),
        "min_child_samples": int(rng.integers(MIN_CHILD_RANGE[0], MIN_CHILD_RANGE[1], endpoint=True)),
        "colsample_bytree": float(rng.uniform(*COLSAMPLE_RANGE)),
    }


def _falls_behind(trial: Trial, finished: Sequence[Trial]) -> bool:
    """Whether a trial's best running mean is worse than the median of earlier trials."""
    folds = len(trial.fold_losses)
    if len(finished) < PRUNE_AFTER_TRIALS or folds <= PRUNE_AFTER_FOLDS:
        return False
    best = min(trial.running(k) for k in range(1, folds + 1))
    return best > statistics.median(t.running(folds) for t in finished)


def _as_if_in_turn(trials: Sequence[Trial], finished: Sequence[Trial]) -> list[Trial]:
    """The trials as they would have come out one after the other: folds past the one at
    which a trial falls behind are taken back."""
    done = list(finished)
    for t in sorted(trials, key=lambda t: t.number):
        losses, t.fold_losses = t.fold_losses, []
        for k, loss in enumerate(losses, start=1):
            t.fold_losses.append(loss)
            if k < len(losses) and _falls_behind(t, [d for d in done if not d.pruned]):
                t.pruned = True
                break
        done.append(t)
    return done


class _TrialTable:
    """Fold losses of a search, one small file each, below a folder of the shared store.

    A search that starts again with the same settings reads them and fits only the rest.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Mapping[str, object]):
        self.spark, self.path = spark, path
        text = json.dumps(settings, sort_keys=True)
        known = self._read(f"{path}/settings", "settings string")
        if not known:
            spark.createDataFrame([(text,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        elif known[0]["settings"] != text:
            raise ValueError(f"'{path}' holds the trials of another search: {known[0]['settings']}")
        found = self._read(f"{path}/losses", "loss double, trial int, fold int")
        self.losses = {(r["trial"], r["fold"]): r["loss"] for r in found}

    def _read(self, path: str, schema: str) -> list:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return self.spark.read.schema(schema).parquet(path).collect()

    def add(self, trial: int, fold: int, loss: float) -> None:
        # a folder of its own, so that trials side by side commit apart
        row = self.spark.createDataFrame([(loss,)], "loss double").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/losses/trial={trial}/fold={fold}")


class _Folds:
    """The rows of one fold and those before it in bins, and the loss of a fit on these.

    With ``alone`` they are sent to every task that fits, a few bytes for each of at most
    ``ROWS_PER_FIT`` rows; otherwise they stay where they are.
    """

    def __init__(self, ready: DataFrame, past: DataFrame, k: int, estimator: GBTClassifier, alone: bool):
        weights = {r[LABEL]: r["weight"] for r in class_weights(past, LABEL).collect()}
        weight = F.lit(1.0)
        for label, w in weights.items():
            weight = F.when(F.col(LABEL) == label, F.lit(w)).otherwise(weight)
        self.context = ready.sparkSession.sparkContext
        self.weights = (weights.get(0.0, 1.0), weights.get(1.0, 1.0))
        self.found = B.find_binning(past.withColumn(WEIGHT, weight), estimator)
        marked = ready.where(F.col("fold") <= k).withColumn(_LATE, F.col("fold") == k)
        self.rows = B.packed(marked, self.found, LABEL, FEATURES, _LATE)
        self.sent = self.context.broadcast(self.rows.collect()) if alone else None

    def loss(self, estimator: GBTClassifier) -> float | None:
        found, settings = self.found, B.settings_of(estimator, self.found, self.weights)
        if self.sent is None:
            _, (total, n) = B.boost(found, settings, self.rows, _EPS)
        else:
            sent, floor = self.sent, _EPS
            one = self.context.parallelize([settings], 1).map(lambda s: B.boost_here(found, s, sent.value, floor))
            total, n = one.first()
        return total / n if n else None


def search_params(
    df: DataFrame,
    columns: Sequence[str],
    date_col: str,
    tie: Sequence[str],
    mode: str = MULTI,
    trials: int = SEARCH_TRIALS,
    rounds: int = SEARCH_ROUNDS,
    folds: int = SEARCH_FOLDS,
    seed: int = SEED,
    parallel: int = 1,
    path: str | None = None,
) -> Search:
    """Seeded random search under expanding time folds, scored by mean fold log-loss.

    The matrix is assembled and written once; every fold of every trial is a
    fit on a filter of it. Only the losses come back to the driver. Two classes are boosted
    on rows that are cut into bins once for each fold: inside one task for each fit where the
    table has fewer than ``ROWS_PER_FIT`` rows, as a job for each level of a tree beyond that.

    ``parallel`` trials run side by side, each in a scheduler pool of its own, or in turn
    where one alone keeps all cores busy. Whether a trial is pruned is decided as if they had
    run in turn, so the result is that of one after the other; the first trials, which are
    never pruned, lose nothing by it, a later one may run folds in vain. With ``path``, a folder of the shared store, every fold's
    loss is written as it comes, and a search that was cut off goes on from there.
    """
    check_mode(mode)
    if parallel < 1:
        raise ValueError(f"no number of trials side by side: {parallel!r}")
    spark = df.sparkSession
    codes = codes_of(mode)
    matrix = fit_matrix(df, columns, label=LABEL, classes=codes)
    folded = expanding_folds(df, date_col, tie, folds)
    ready = materialise_dealt(
        matrix.transform_training(folded, LABEL, [date_col, *tie]).select(F.col(LABEL).cast("double").alias(LABEL), "fold", FEATURES),
        ROWS_PER_TASK,
    )
    n = ready.count()
    parallel = _side_by_side(ready, parallel, n)
    pasts = {k: ready.where(F.col("fold") < k) for k in range(1, folds + 1)}
    rng = np.random.default_rng(seed)
    drawn = [Trial(number, draw_params(rng)) for number in range(trials)]
    boosted = {}
    if mode == BINARY and drawn:
        # weights, cut points and bins are worked out once per fold, not per trial
        alone = n < ROWS_PER_FIT and _side_by_side(ready, 2, n) > 1  # the fits side by side keep the cores busy
        some = build(mode, drawn[0].params, rounds, matrix.layout.max_levels, seed)
        boosted = {k: _Folds(ready, pasts[k], k, some, alone) for k in pasts}
    table = None
    if path is not None:
        # the rows count by what is fitted on them: blocks, labels and input columns
        blocks = ready.groupBy("fold", LABEL).count().orderBy("fold", LABEL).collect()
        settings = {
            "columns": list(columns), "mode": mode, "rounds": rounds, "folds": folds, "seed": seed,
            "blocks": [[r["fold"], r[LABEL], r["count"]] for r in blocks],
        }
        table = _TrialTable(spark, path, settings)

    def loss_of(trial: Trial, k: int) -> float:
        if table and (trial.number, k) in table.losses:
            return table.losses[trial.number, k]
        estimator = build(mode, trial.params, rounds, matrix.layout.max_levels, seed)
        if boosted:
            loss = boosted[k].loss(estimator)
        else:
            p = vector_to_array("probability")
            columns_of_p = [f"__p{c}" for c in codes]
            scored = estimator.fit(pasts[k]).transform(ready.where(F.col("fold") == k))
            spread = scored.select(LABEL, *[p[c].alias(n) for c, n in zip(codes, columns_of_p)])
            loss = log_loss(spread, LABEL, columns_of_p).first()["logloss"]
        if table:
            table.add(trial.number, k, loss)
        return loss

    done: list[Trial] = []

    def run(trial: Trial) -> Trial:
        for k in range(1, folds + 1):
            trial.fold_losses.append(loss_of(trial, k))
            # with others beside it, what it is held against is known only afterwards
            if parallel == 1 and k < folds and _falls_behind(trial, [t for t in done if not t.pruned]):
                trial.pruned = True
                break
        return trial

    if parallel == 1:
        for trial in drawn:
            done.append(run(trial))
        return Search(done)

    @inheritable_thread_target(spark)
    def run_beside(trial: Trial) -> Trial:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial {trial.number}")
        return run(trial)

    with ThreadPoolExecutor(parallel) as pool:
        for first in range(0, trials, parallel):
            done = _as_if_in_turn(list(pool.map(run_beside, drawn[first : first + parallel])), done)
    return Search(done)
