"""Joins against a table of distinct keys when one key may hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that share a hot key, for each shuffle partition, and at least.
SALTS_PER_PARTITION, MIN_SALTS = 1 / 8, 8


def join_distinct(
    rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi", salts: int | None = None
) -> DataFrame:
    """Join ``rows`` to ``keys``, which holds each value of ``key`` once.

    Every key row is repeated once per salt and every data row carries a salt
    from its place in its input split, so a hot key is spread over ``salts``
    tasks, also where its rows are alike. The number of salts follows the
    shuffle partitions unless given: more tasks for a hot key on a larger
    cluster, at the price of more copies of the keys. A following aggregation by
    the key cannot reuse that placement, so it reduces the rows map-side before
    they meet. The copies are merged and never broadcast: Spark would judge by the
    size of the keys' file, of which the driver would hold every copy.
    """
    if salts is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(MIN_SALTS, round(SALTS_PER_PARTITION * partitions))
    # the place is the same whenever the split is read again
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    copies = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [key, "__salt"], how).drop("__salt")
