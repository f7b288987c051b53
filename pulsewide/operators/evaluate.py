"""Classifier evaluation as aggregations over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.functions import columns as C
from pulsewide.operators.ordering import running_totals
from pulsewide.operators.profile import cross_tab, row_percent
from pulsewide.session import materialise

# fixed value: probability floor of the log-loss, the double machine epsilon
_EPS = 2.220446049250313e-16


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_class)``: one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    )


def log_loss(df: DataFrame, label: str, probabilities: Sequence[str]) -> DataFrame:
    """Mean log-loss; ``probabilities[k]`` is the column of class ``k``.

    The row's probabilities are clipped away from 0 and 1 as the usual
    definition does. Rows without a label, of another class, or without a
    probability have no loss: ``n`` counts the others, ``n_unknown`` these.
    """
    p = F.lit(None).cast("double")
    for code, name in enumerate(probabilities):
        p = F.when(F.col(label) == code, F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))).otherwise(p)
    clipped = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1.0 - _EPS)), F.lit(_EPS)))
    return df.agg(
        F.avg(-F.ln(clipped)).alias("logloss"), F.count(clipped).alias("n"),
        F.count_if(clipped.isNull()).alias("n_unknown"),
    )


def _pair_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def report(df: DataFrame, label: str, prediction: str, codes: Sequence[int]) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages.

    Rows ``(class, precision, recall, f1, support)``. One aggregation to at
    most classes-squared counts; a division by zero gives 0.
    """
    names = C.labels_for(codes)
    n, y, p = F.col("n"), F.col("y"), F.col("p")
    pairs = _pair_counts(df, label, prediction)
    one = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(y == p, n)), F.lit(0)).alias("hits"),
        *[F.coalesce(F.sum(F.when((y == c) & (p == c), n)), F.lit(0)).alias(f"tp{c}") for c in codes],
        *[F.coalesce(F.sum(F.when(p == c, n)), F.lit(0)).alias(f"pred{c}") for c in codes],
        *[F.coalesce(F.sum(F.when(y == c, n)), F.lit(0)).alias(f"true{c}") for c in codes],
    )

    def scores(c: int) -> tuple:
        precision = C.guarded_ratio(F.col(f"tp{c}"), F.col(f"pred{c}"))
        recall = C.guarded_ratio(F.col(f"tp{c}"), F.col(f"true{c}"))
        f1 = C.guarded_ratio(2 * F.col(f"tp{c}"), F.col(f"pred{c}") + F.col(f"true{c}"))
        return precision, recall, f1

    def line(name: str, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1"),
            support.cast("bigint").alias("support"),
        )

    per_class = {c: scores(c) for c in codes}
    support = {c: F.col(f"true{c}") for c in codes}
    total = sum(support.values(), F.lit(0))
    accuracy = C.guarded_ratio(F.col("hits"), F.col("all"))
    mean = lambda i: sum((per_class[c][i] for c in codes), F.lit(0.0)) / len(codes)
    weighted = lambda i: C.guarded_ratio(
        sum((per_class[c][i] * support[c] for c in codes), F.lit(0.0)), total
    )
    lines = [line(names[c], *per_class[c], support[c]) for c in codes]
    lines.append(line("accuracy", accuracy, accuracy, accuracy, F.col("all")))
    lines.append(line("macro avg", mean(0), mean(1), mean(2), total))
    lines.append(line("weighted avg", weighted(0), weighted(1), weighted(2), total))
    return one.select(F.inline(F.array(*lines)))


def confusion(df: DataFrame, label: str, prediction: str, codes: Sequence[int]) -> DataFrame:
    """Counts and row percent for every (true, predicted) pair of ``codes``, present or not."""
    spark = df.sparkSession
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p"))
    table = cross_tab(rows, "y", "p", codes, prefix="pred_").drop("total")
    listed = spark.createDataFrame([(c,) for c in codes], "y int")
    # one row per class
    full = listed.join(F.broadcast(table), "y", "left").na.fill(0)
    return row_percent(full, [f"pred_{c}" for c in codes])


def precision_recall(
    df: DataFrame, label: str, score: str, beta: float = 2.0
) -> DataFrame:
    """Precision, recall and F-beta of ``score >= threshold`` at every distinct score.

    Scores are first reduced to distinct values with their counts, which are
    written; cuts, positives and curve come from these, so the input is read
    once. Rows without a score or a label are left out.
    """
    rows = df.select(
        F.lit("all").alias("__g"), F.col(score).alias("threshold"), F.col(label).cast("bigint").alias("__y")
    ).where(F.col("threshold").isNotNull() & F.col("__y").isNotNull())
    counts = materialise(rows.groupBy("__g", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("pos")))
    curve = running_totals(counts, "__g", "threshold", ["n", "pos"], descending=True)
    positives = counts.agg(F.sum("pos")).scalar()
    b = beta * beta
    precision, recall = F.col("precision"), F.col("recall")
    return (
        curve.select(
            "threshold",
            F.col("cum_n").alias("predicted"),
            F.col("cum_pos").alias("tp"),
            C.guarded_ratio(F.col("cum_pos"), F.col("cum_n")).alias("precision"),
            # fixed value: without positives, recall is 1 by convention
            F.coalesce(F.try_divide(F.col("cum_pos"), positives), F.lit(1.0)).alias("recall"),
        )
        .withColumn(
            "fbeta",
            C.guarded_ratio((1 + b) * precision * recall, b * precision + recall),
        )
    )


def best_threshold(df: DataFrame, label: str, score: str, beta: float = 2.0) -> DataFrame:
    """The row of the curve with the largest F-beta; the lowest threshold on ties."""
    return (
        precision_recall(df, label, score, beta).orderBy(F.desc("fbeta"), "threshold").limit(1)
    )


def optimal_threshold(
    df: DataFrame, label: str, score: str, codes: Sequence[int], beta: float = 2.0
) -> float:
    if len(codes) != 2:
        raise ValueError(f"threshold tuning needs a binary model; got classes {list(codes)}")
    return float(best_threshold(df, label, score, beta).first()["threshold"])


def with_expected_score(
    df: DataFrame, probability: str, codes: Sequence[int], name: str = "expected_score"
) -> DataFrame:
    """Add P(promoter) minus P(detractor), times 100, from an array of class probabilities."""
    if S.DETRACTOR not in codes or S.PROMOTER not in codes:
        raise ValueError(f"classes {list(codes)} lack the detractor or the promoter class")
    at = lambda code: F.col(probability)[list(codes).index(code)]
    return df.withColumn(name, C.expected_score(at(S.PROMOTER), at(S.DETRACTOR)))
