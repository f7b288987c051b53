"""The three end-to-end flows: train, score the Live population, intervene."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.operators.attribute import Explainer, attribute, make_explainer
from pulsewide.operators.correlate import Drop, collinearity_filter
from pulsewide.operators.counterfactual import Counterfactual, new_lever, simulate
from pulsewide.operators.encode import Vocabulary, apply_vocabulary, drop_redundant, encode_tokens
from pulsewide.operators.evaluate import optimal_threshold
from pulsewide.operators.matrix import LABEL, binary_target, feature_columns, multi_target
from pulsewide.operators.model import BINARY, FINAL_ROUNDS, Classifier, train
from pulsewide.operators.pivot import active_history, add_severe_flag, load_wide, with_class
from pulsewide.operators.split import oot_split
from pulsewide.session import materialise

_ROW = "__row"


@dataclass(frozen=True)
class FeatureTable:
    table: DataFrame
    vocabulary: Vocabulary
    redundant: list[tuple[str, str]]
    collinear: list[Drop]


def train_features(
    eav: DataFrame,
    types: Mapping[str, str],
    threshold: float = 0.85,
    priority: Sequence[str] = S.PRIORITY_LEVERS,
    max_features: int = S.DEFAULT_VOCABULARY_SIZE,
) -> FeatureTable:
    """Pivot, label, encode, flag, and prune. The wide table is written once.

    Two raw dates may read alike, so the rows get a number of their own for the
    rank correlations; it is fixed once written.
    """
    wide = materialise(with_class(load_wide(eav, types)).withColumn(_ROW, F.monotonically_increasing_id()))
    multi = [c for c, t in types.items() if t == S.MULTI_CATEGORICAL and c in wide.columns]
    encoded, vocabulary = encode_tokens(wide, multi, max_features)
    flagged = add_severe_flag(encoded)
    slim, redundant = drop_redundant(flagged)
    pruned, collinear = collinearity_filter(slim, [_ROW], threshold, priority)
    return FeatureTable(pruned.drop(_ROW), vocabulary, redundant, collinear)


@dataclass(frozen=True)
class Trained:
    classifier: Classifier
    train: DataFrame
    test: DataFrame
    threshold: float | None


def train_flow(
    features: DataFrame, params: Mapping[str, float], mode: str = BINARY,
    rounds: int = FINAL_ROUNDS, beta: float = 2.0, test_size: float = 0.2,
) -> Trained:
    """Split by time, fit, and for two classes tune the decision threshold on the newer part."""
    labelled = (binary_target if mode == BINARY else multi_target)(features)
    older, newer = oot_split(labelled, "npsDate", ["sourceId", "sourceUniqueId"], test_size)
    classifier = train(older, feature_columns(features), params, mode, rounds)
    threshold = None
    if mode == BINARY:
        # the curve reads the scores several times
        scored = materialise(classifier.score_positive(newer).select(LABEL, "p"))
        threshold = optimal_threshold(scored, LABEL, "p", classifier.codes, beta)
    return Trained(classifier, older, newer, threshold)


def live_features(
    eav: DataFrame, types: Mapping[str, str], vocabulary: Vocabulary, active_only: bool = True
) -> DataFrame:
    """Live rows prepared like the training rows, for active customers; no row cap.

    The semi-join keeps dormant customers out of the pivot's shuffle.
    """
    history = active_history(eav) if active_only else eav
    ready = add_severe_flag(apply_vocabulary(load_wide(history, types), vocabulary))
    return ready.where(F.col(S.SEVERE_FLAG_COL).isNotNull()) if active_only else ready


def score_live(ready: DataFrame, classifier: Classifier) -> DataFrame:
    """One lazy plan: align to the training columns, encode, score."""
    return classifier.score_positive(ready)


def counterfactual_flow(
    spark: SparkSession,
    ready: DataFrame,
    classifier: Classifier,
    intervention: Sequence[str] = S.INTERVENTION_COLS,
    lever: str = S.DELAY_COL,
    keep: Sequence[str] = ("sourceId",),
) -> tuple[Counterfactual, DataFrame, Explainer]:
    """Effect of zeroing the drivers over all given rows, and the lever that ranks next."""
    explainer = make_explainer(spark, classifier)
    ready = materialise(ready)
    outcome = simulate(ready, classifier, explainer, intervention, keep)
    outcome = replace(outcome, attributed=materialise(outcome.attributed))
    before = attribute(ready, classifier, explainer, keep)
    return outcome, new_lever(before, outcome.attributed, explainer, lever, intervention), explainer
