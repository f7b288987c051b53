"""Naive zero-out intervention: what the model predicts if some drivers were 0.

The changed rows may lie outside what the model was trained on, so the effect
is a direction and not a causal estimate.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewide.operators.attribute import Explainer, attribute, importance
from pulsewide.operators.matrix import zero_out
from pulsewide.operators.model import Classifier


@dataclass(frozen=True)
class Counterfactual:
    summary: DataFrame          # one row: rates and effect
    changed: DataFrame          # rows after the intervention
    attributed: DataFrame       # their contributions
    absent: list[str]           # intervention columns that do not exist


def rates(df: DataFrame, intervention: Sequence[str], classifier: Classifier) -> DataFrame:
    """Mean probability before and after, absolute and relative effect; one row.

    Both scores are narrow transforms of the same row, so the table is read once.
    """
    before = classifier.score_positive(df, "__before")
    both = classifier.score_positive(zero_out(before, intervention)[0], "__after")
    ate = F.col("baseline_rate") - F.col("cf_rate")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__before").alias("baseline_rate"),
        F.avg("__after").alias("cf_rate"),
    ).select(
        "n", "baseline_rate", "cf_rate", ate.alias("ate"),
        F.try_divide(ate, F.col("baseline_rate")).alias("relative_reduction"),
    )


def simulate(
    df: DataFrame,
    classifier: Classifier,
    explainer: Explainer,
    intervention: Sequence[str],
    keep: Sequence[str],
) -> Counterfactual:
    """Zero the intervention columns, score both worlds and attribute the changed one."""
    changed, absent = zero_out(df, intervention)
    if absent:
        warnings.warn(f"intervention columns not found: {absent}", stacklevel=2)
    return Counterfactual(
        rates(df, intervention, classifier),
        changed,
        attribute(changed, classifier, explainer, keep),
        absent,
    )


def new_lever(
    baseline: DataFrame,
    changed: DataFrame,
    explainer: Explainer,
    lever: str,
    intervention: Sequence[str],
) -> DataFrame:
    """Mean contribution of the lever before, the strongest other column after, and their ratio."""
    before = importance(baseline, explainer).where(F.col("feature") == lever)
    after = (
        importance(changed, explainer)
        .where(~F.col("feature").isin(list(intervention)))
        .orderBy(F.desc("mean_abs_shap"), "feature")
        .limit(1)
    )
    first = before.select("mean_abs_shap")
    return after.select(
        F.lit(lever).alias("lever"),
        first.scalar().alias("lever_mean_abs_shap"),
        F.col("feature").alias("new_lever"),
        F.col("mean_abs_shap").alias("new_mean_abs_shap"),
    ).withColumn("ratio", F.try_divide("lever_mean_abs_shap", "new_mean_abs_shap"))
