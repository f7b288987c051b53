"""Attribute-value input: CSV and Parquet readers, driver definitions, landing."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.functions import columns as C

ORDINAL = "ord"
#: Bytes of one file and number of files that the row order has room for: 2^44 and 2^19.
_FILE_SHIFT = 44
MAX_FILES = 1 << (63 - _FILE_SHIFT)
KNOWN_TYPES = [S.NUMERIC, S.CATEGORICAL, S.MULTI_CATEGORICAL]


def read_definitions(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Driver definitions as ``({key: type}, rows with an unknown type)``.

    The map has one entry per driver (tens), so it lives on the driver program.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path).select("key", "dataType")
    known = F.col("dataType").isin(KNOWN_TYPES)
    unknown = rows.where(~F.coalesce(known, F.lit(False)))
    listed = rows.where(known).collect()
    bad = [r["key"] for r in unknown.select("key").collect()]
    if bad:
        warnings.warn(f"drivers of unknown type stay text: {bad}", stacklevel=2)
    return {r["key"]: r["dataType"] for r in listed}, unknown


def read_csv(spark: SparkSession, path: str | list[str], with_ordinal: bool = True) -> DataFrame:
    """Attribute-value CSV with every column as text, plus the row order ``ord``.

    Each file's header is checked against the first one's, so a file whose
    columns come in another order is an error and not misread. Quotes inside a
    quoted value are doubled; a line break inside a value is not supported.
    ``ord`` is a long that ascends by file (in the order of their paths) and
    then by place in the file.
    """
    raw = (
        spark.read.schema(S.strings(*spark.read.option("header", True).option("escape", '"').csv(path).columns))
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        # an empty cell and a quoted empty cell both arrive as NULL or ''
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return _with_position(raw) if with_ordinal else raw


def _with_position(raw: DataFrame) -> DataFrame:
    """Add the row order of files that Spark splits.

    A split starts at a byte of its file, and its rows have two bytes or more,
    so the start plus the row's number in the split ascends in the file and
    meets no other split. The file's number stands above. One fixed-width
    number keeps the pivot of numeric drivers a hash aggregation.
    """
    # the two listings write a local path with one slash or three
    files = sorted(re.sub("^file:/+", "file:/", f) for f in raw.inputFiles())
    if len(files) > MAX_FILES:
        raise ValueError(f"{len(files)} files; the row order has room for {MAX_FILES}")
    names = raw.columns
    # bounded by MAX_FILES rows
    numbers = raw.sparkSession.createDataFrame(list(enumerate(files)), "__file bigint, __path string")
    placed = raw.select(
        *names, F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__path"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"),
    )
    file = F.coalesce("__file", F.raise_error(F.concat(F.lit("unlisted input file "), "__path")).cast("bigint"))
    position = F.shiftleft(file, _FILE_SHIFT) + F.col("__start") + F.col("__row")
    return placed.join(F.broadcast(numbers), "__path", "left").select(*names, position.alias(ORDINAL))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def land(eav: DataFrame, path: str) -> None:
    """Write attribute-value rows as Parquet sorted by attribute inside each file.

    No shuffle: every input split becomes one file. The sort gives row groups
    narrow attribute ranges, so a job that needs one attribute skips the rest.
    """
    eav.sortWithinPartitions(S.KEY_COL).write.mode("overwrite").parquet(path)


def sample_entities(
    df: DataFrame, entity: str, keep: int, out_of: int, seed: int = 42
) -> DataFrame:
    """Keep whole entities: those whose hash falls in ``keep`` of ``out_of`` parts.

    A filter, so it is pushed into the scan stage and needs no shuffle; the same
    entity is in or out in every table and every run.
    """
    if not 0 < keep <= out_of:
        raise ValueError(f"keep must be in 1..{out_of}; got {keep}")
    return df.where(C.seeded_hash(seed, F.col(entity)) % out_of < keep)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet sink, optionally one folder per value of ``by`` (a date, a class)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)

