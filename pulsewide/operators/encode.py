"""Top-K token encoding of multi-valued text columns, and the audited column drop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.functions import columns as C


@dataclass(frozen=True)
class Vocabulary:
    """Fitted tokens: rows ``(column, position, token, output_name)``.

    At most K rows per encoded column, so the rows are held on the driver and
    become literals of the transform.
    """

    columns: tuple[str, ...]
    rows: tuple[tuple[str, int, str, str], ...]

    @property
    def output_columns(self) -> dict[str, list[str]]:
        return {c: [r[3] for r in self.rows if r[0] == c] for c in self.columns}

    def as_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.rows), "column string, position int, token string, output_name string"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.as_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Vocabulary:
        rows = [tuple(r) for r in spark.read.parquet(path).orderBy("column", "position").collect()]
        return Vocabulary(tuple(dict.fromkeys(r[0] for r in rows)), tuple(rows))


def vocabulary_table(
    df: DataFrame, columns: Sequence[str], max_features: int = S.DEFAULT_VOCABULARY_SIZE
) -> DataFrame:
    """The K tokens found in most rows, per column: ``(column, token, n, position, output_name)``.

    A token counts once per row. Equal counts go by token. Positions and names
    follow the alphabetical order of the kept tokens; a name taken by an
    earlier token of the column gets a numbered suffix.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.array_distinct(C.tokens(F.col(c))).alias("tokens"))
        for c in columns
    ])
    counts = (
        df.select(F.inline(cells))
        .select("column", F.explode("tokens").alias("token"))
        .groupBy("column", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "token")
    by_name = Window.partitionBy("column").orderBy("token")
    same_name = Window.partitionBy("column", "__base").orderBy("token")
    repeat = F.row_number().over(same_name)
    return (
        # the rank filter is applied map-side first, so only K rows per column and task move
        counts.withColumn("__r", F.row_number().over(by_count))
        .where(F.col("__r") <= max_features)
        .withColumn("position", F.row_number().over(by_name) - 1)
        .withColumn("__base", F.concat("column", F.lit("__"), C.sanitise(F.col("token"))))
        .withColumn(
            "output_name",
            F.when(repeat == 1, F.col("__base")).otherwise(
                F.concat("__base", F.lit("_"), repeat.cast("string"))
            ),
        )
        .select("column", "token", "n", "position", "output_name")
    )


def fit_vocabulary(
    df: DataFrame, columns: Sequence[str], max_features: int = S.DEFAULT_VOCABULARY_SIZE
) -> Vocabulary:
    found = vocabulary_table(df, columns, max_features).collect()
    rank = {c: i for i, c in enumerate(columns)}
    rows = sorted(
        ((r["column"], r["position"], r["token"], r["output_name"]) for r in found),
        key=lambda r: (rank[r[0]], r[1]),
    )
    return Vocabulary(tuple(columns), tuple(rows))


def apply_vocabulary(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Replace each encoded column by its 0/1 columns; an absent column is skipped."""
    present = [c for c in vocabulary.columns if c in df.columns]
    if not present:
        return df
    held = {c: f"__tokens_{i}" for i, c in enumerate(present)}
    split = df.select("*", *[C.tokens(F.col(c)).alias(held[c]) for c in present])
    kept = [F.col(c) for c in df.columns if c not in held]
    added = [
        F.array_contains(held[c], F.lit(token)).cast("tinyint").alias(name)
        for c, _, token, name in vocabulary.rows
        if c in held
    ]
    return split.select(*kept, *added)


def encode_tokens(
    df: DataFrame,
    columns: Sequence[str],
    max_features: int = S.DEFAULT_VOCABULARY_SIZE,
    vocabulary: Vocabulary | None = None,
) -> tuple[DataFrame, Vocabulary]:
    """Fit where no vocabulary is given, then transform."""
    if vocabulary is None and not columns:
        return df, Vocabulary((), ())
    vocabulary = vocabulary or fit_vocabulary(df, columns, max_features)
    return apply_vocabulary(df, vocabulary), vocabulary


def drop_redundant(
    df: DataFrame, pairs: dict[str, str] | None = None
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Drop bracket columns whose numeric counterpart is audited: ``(df, [(dropped, kept)])``."""
    pairs = S.SEMANTIC_REDUNDANCIES if pairs is None else pairs
    report = [(c, keeper) for c, keeper in pairs.items() if c in df.columns]
    return df.drop(*[c for c, _ in report]), report
