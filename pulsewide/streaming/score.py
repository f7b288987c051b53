"""Live scoring of wide rows as they arrive.

Preparation and scoring are narrow per row, so the stream keeps no state and
any number of rows passes through with bounded memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from pulsewide import schema as S
from pulsewide.operators.encode import Vocabulary, apply_vocabulary
from pulsewide.operators.model import Classifier
from pulsewide.operators.pivot import add_severe_flag


def read_wide_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Wide Parquet files of a folder as a stream, a bounded number of files per batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(
    wide: DataFrame, vocabulary: Vocabulary, classifier: Classifier, source: str = S.DELAY_COL,
    threshold: float = S.SEVERE_THRESHOLD,
) -> DataFrame:
    """Encode, flag, keep active customers, score: the batch plan on a stream."""
    ready = add_severe_flag(apply_vocabulary(wide, vocabulary), threshold, source)
    return classifier.score_positive(ready.where(F.col(S.SEVERE_FLAG_COL).isNotNull()))


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scores as Parquet, each input file exactly once, until the folder is used up."""
    return (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
