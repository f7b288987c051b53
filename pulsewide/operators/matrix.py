"""Feature matrix at the model boundary, and alignment of new data to it.

Tables keep NULL as "nothing recorded". Only here, where MLlib trees accept no
missing value, a nullable number becomes two inputs: the value with an
out-of-range low stand-in, and a 0/1 mark of absence, so that a tree can send
missing rows to either side. The stand-ins are part of the saved pipeline.

Text columns of up to ``MAX_LEVELS`` levels become category codes. Wider ones become shares
of the label's classes by level, which need the label and an order of the training rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide import schema as S
from pulsewide.functions import columns as C
from pulsewide.operators.levels import WideText, encode_new, encode_ordered, fit_wide_text
from pulsewide.operators.profile import level_counts
from pulsewide.operators.salting import join_distinct

FEATURES = "features"
LABEL = "label"
#: Levels of a text column that MLlib splits as categories; all of them go to the driver.
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Layout:
    """Which columns feed the model, which original column each input slot belongs to, and
    the classes of the columns that are wide texts."""

    columns: list[str]
    types: list[str]
    slots: list[int]
    max_levels: int
    wide: dict[str, list[int]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Layout:
        return Layout(**json.loads(text))


@dataclass(frozen=True)
class Matrix:
    """Fitted encoding from a feature table to the vector column."""

    layout: Layout
    pipeline: PipelineModel
    wide: tuple[WideText, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode new rows."""
        aligned = align(df, self.layout, keep_other=True)
        for w in self.wide:
            aligned = encode_new(aligned, w)
        return self._assembled(aligned)

    def transform_training(self, df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
        """Encode the rows that the encoding was learned from: no row's input depends on
        its own label or on that of a later row."""
        aligned = align(df, self.layout, keep_other=True)
        for w in self.wide:
            aligned = encode_ordered(aligned, w, label, order)
        return self._assembled(aligned)

    def _assembled(self, aligned: DataFrame) -> DataFrame:
        helpers = {c for stage in self.pipeline.stages for c in _made_by(stage)}
        out = self.pipeline.transform(aligned)
        return out.drop(*[c for c in helpers if c != FEATURES])

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(path + "/pipeline")
        for i, w in enumerate(self.wide):
            w.levels.write.mode("overwrite").parquet(f"{path}/levels/{i}")
        row = spark.createDataFrame([(self.layout.to_json(),)], "layout string")
        row.coalesce(1).write.mode("overwrite").parquet(path + "/layout")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Matrix:
        layout = Layout.from_json(spark.read.parquet(path + "/layout").first()["layout"])
        wide = tuple(
            WideText(c, tuple(classes), spark.read.parquet(f"{path}/levels/{i}"))
            for i, (c, classes) in enumerate(layout.wide.items())
        )
        return Matrix(layout, PipelineModel.load(path + "/pipeline"), wide)


def _filled(c: str) -> str:
    return f"__filled_{c}"


def _absent(c: str) -> str:
    return f"__absent_{c}"


def _coded(c: str) -> str:
    return f"__coded_{c}"


def _made_by(stage) -> list[str]:
    if isinstance(stage, VectorAssembler):
        return list(stage.getInputCols())
    return []


def feature_columns(df: DataFrame, also_meta: Sequence[str] = ()) -> list[str]:
    """Every column that is not identifying, dated or a target."""
    meta = {*S.META_COLS, LABEL, *also_meta}
    return [c for c in df.columns if c not in meta]


def binary_target(df: DataFrame, target: str = S.CLASS_COL, name: str = LABEL) -> DataFrame:
    """Label 1 for detractors and 0 for the rest; rows of the unknown class are left out."""
    _need(df, target)
    return df.where(F.col(target) != S.UNKNOWN_CLASS).withColumn(name, C.is_detractor(F.col(target)))


def multi_target(df: DataFrame, target: str = S.CLASS_COL, name: str = LABEL) -> DataFrame:
    """Label equal to the class code; rows of the unknown class are left out."""
    _need(df, target)
    return df.where(F.col(target) != S.UNKNOWN_CLASS).withColumn(name, F.col(target).cast("int"))


def _need(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise KeyError(f"no column '{target}' to learn from")


def _wide_columns(df: DataFrame, texts: Sequence[str], most: int) -> dict[str, int]:
    """The text columns with more levels than MLlib should split as categories."""
    if not texts:
        return {}
    counted = level_counts(df, texts).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    found = {r["column"]: r["n"] for r in counted.where(F.col("n") > most).collect()}
    return {c: found[c] for c in texts if c in found}


def fit_matrix(
    df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS,
    label: str | None = None, classes: Sequence[int] = (0, 1),
) -> Matrix:
    """Learn stand-ins, category codes and levels' shares from the training rows.

    No level is dropped. A text column with more than ``max_levels`` is encoded by the
    ``classes`` of ``label``; without a label it is an error.
    """
    fields = [df.schema[c] for c in columns]
    numbers = [f.name for f in fields if S.is_numeric(f) or isinstance(f.dataType, T.BooleanType)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    other = [f.name for f in fields if f.name not in {*numbers, *texts}]
    if other:
        raise TypeError(f"columns are neither numbers nor text: {other}")

    as_double = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in numbers:
        aggs += [F.min(as_double(c)).alias(f"lo|{c}"), F.count(as_double(c)).alias(f"n|{c}")]
    stats = df.agg(*aggs).first()

    pieces, inputs, slots = [], [], []
    for c in numbers:
        low = stats[f"lo|{c}"]
        stand_in = repr(-1.0 if low is None else low - 1.0)
        value = f"nanvl(cast(`{c}` as double), cast(null as double))"
        pieces.append(f"coalesce({value}, double('{stand_in}')) AS `{_filled(c)}`")
        inputs.append(_filled(c))
        slots.append(list(columns).index(c))
        if stats[f"n|{c}"] < stats["__n"]:
            pieces.append(f"cast({value} is null as double) AS `{_absent(c)}`")
            inputs.append(_absent(c))
            slots.append(list(columns).index(c))
    wide_names = _wide_columns(df, texts, max_levels)
    if wide_names and label is None:
        raise ValueError(f"more than {max_levels} levels in text columns {wide_names}; give a label to encode them by")
    wide = tuple(fit_wide_text(df, c, label, classes) for c in wide_names)
    texts = [c for c in texts if c not in wide_names]
    stages = []
    if pieces:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(pieces)} FROM __THIS__"))
    if texts:
        stages.append(StringIndexer(
            inputCols=texts, outputCols=[_coded(c) for c in texts], handleInvalid="keep"
        ))
        inputs += [_coded(c) for c in texts]
        slots += [list(columns).index(c) for c in texts]
    for w in wide:
        inputs += w.outputs
        slots += [list(columns).index(w.column)] * len(w.outputs)
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    with_shares = df.withColumns({o: F.lit(0.0) for w in wide for o in w.outputs})  # their names are all that is learned
    pipeline = Pipeline(stages=stages).fit(with_shares)
    levels = [len(l) for s in pipeline.stages if hasattr(s, "labelsArray") for l in s.labelsArray]
    layout = Layout(
        list(columns), [f.dataType.simpleString() for f in fields], slots, max(levels, default=0),
        {w.column: list(w.classes) for w in wide},
    )
    return Matrix(layout, pipeline, wide)


def align(df: DataFrame, layout: Layout, keep_other: bool = False) -> DataFrame:
    """Feature columns in training order and type: an absent one is NULL, an extra one goes.

    ``keep_other`` carries the remaining columns (ids, label) along in front.
    """
    wanted = [
        (F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
        for c, t in zip(layout.columns, layout.types)
    ]
    carried = [F.col(c) for c in df.columns if c not in layout.columns] if keep_other else []
    return df.select(*carried, *wanted)


def category_domain(df: DataFrame, column: str) -> DataFrame:
    """Known categories of a text column, one row each."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def align_categories(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """A category outside ``domain`` (one row each) becomes NULL.

    A join for domains of any size; Spark broadcasts a small one by its size.
    """
    listed = domain.select(F.col(column), F.col(column).alias("__known"))
    return join_distinct(df, listed, column, "left").withColumn(column, F.col("__known")).select(*df.columns)


def zero_out(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Set columns to a zero of their own type, also where NULL: ``(df, absent columns)``."""
    absent = [c for c in columns if c not in df.columns]
    present = [c for c in columns if c in df.columns]
    changed = {c: F.lit(0).cast(df.schema[c].dataType) for c in present}
    return (df.withColumns(changed) if changed else df), absent
