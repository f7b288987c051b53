"""Views over the test tables that stand in for the analysis inputs.

Each is a lazy DataFrame over whole Parquet tables; columns a query does not
use are pruned from the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.operators.pivot import add_severe_flag, pivot_first, type_meta, with_class
from pulsewide.session import landed

KEYS = ["click", "error", "purchase", "signup", "view"]
TYPES = {k: S.NUMERIC for k in KEYS}
INDEX = ["entity_id", "obs_date_raw", "score_raw"]
NUMERIC_FEATURES = [
    "total_price", "delay_days", "qty_sum", "price_sum", "disc_avg", "n_lines",
    "price_alias", "const_col",
]
SEVERE_DAYS = 365.0
DELAY = "delay_days"
FLAG = "is_severe"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attribute-value rows, all text, with empty and unparseable values."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    raw = (
        F.when(F.col("event_id") % 7 == 0, F.lit(""))
        .when(F.col("event_id") % 11 == 0, F.lit("n/a"))
        .otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
    )
    score = F.element_at(
        F.array(*[F.lit(s) for s in ("0", "7", "10", "5")]),
        ((F.col("user_id") * 31 + F.dayofmonth(day)) % 4 + 1).cast("int"),
    )
    return e.select(
        F.col("user_id").alias("entity_id"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("obs_date_raw"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("attr_key"),
        raw.alias("raw_value"),
        score.alias("score_raw"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivoted and typed events: ids, date, score, class and one float column per key."""
    pivoted = pivot_first(eav(spark, sf_dir), TYPES, INDEX, "ord", "attr_key", "raw_value")
    renamed = pivoted.withColumnsRenamed({"obs_date_raw": "obs_date", "score_raw": "score"})
    return with_class(type_meta(renamed, "obs_date", "score"), "score")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the order features that needs no lines."""
    code = F.col("o_orderkey") * 7919 % 4
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("cust_id"),
        F.to_date("o_orderdate").alias("obs_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total_price"),
        F.when(code < 3, code).otherwise(-1).cast("int").alias("nps_class"),
    )


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the aggregates of its lines; NULL where it has none.

    Lines are reduced to one row per order and shipping day before the join, so
    an order that holds a large share of all lines arrives as few rows. Sums of
    fractions are rounded, because ranks need equal values to be equal whatever
    the order of summation was.
    """
    o = orders(spark, sf_dir)
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("row_id"), F.to_date("l_shipdate").alias("shipped"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("qty"),
            F.sum("l_extendedprice").alias("price"),
            F.sum("l_discount").alias("disc"),
        )
    )
    days = F.greatest(F.datediff("shipped", "obs_date"), F.lit(0))
    n = F.sum("n")
    # the join already places the rows by order, so the aggregation moves nothing
    joined = (
        o.join(lines, "row_id", "left")
        .groupBy(*o.columns)
        .agg(
            (F.sum(days * F.col("n")) / n).alias("delay_days"),
            F.sum("qty").alias("qty_sum"),
            F.round(F.sum("price"), 2).alias("price_sum"),
            F.round(F.sum("disc") / n, 9).alias("disc_avg"),
            n.alias("n_lines"),
        )
    )
    near_copy = F.when(
        F.col("row_id") % 5 != 0, F.col("price_sum") * 2 + F.col("row_id") % 3
    )
    return joined.select(
        "row_id", "cust_id", "obs_date", "priority", "status", "total_price",
        "delay_days", "qty_sum", "price_sum", "disc_avg", "n_lines",
        near_copy.alias("price_alias"),
        F.lit(1.0).alias("const_col"),
        "nps_class",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order features as a written table, for operators that read their input several times."""
    return landed(f"order_features:{sf_dir}", lambda: order_features(spark, sf_dir), spark)


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as ``||``-separated tokens, with gaps, repeats and padding."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("||"))
    text = (
        F.when(key % 9 == 0, F.lit(None).cast("string"))
        .when(key % 13 == 0, F.lit("||"))
        .when(key % 4 == 0, F.concat(name, F.lit("|| "), name))
        .otherwise(name)
    )
    return p.select("p_partkey", text.alias("tokens"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled orders with a fixed score: ``(row_id, nps_class, y, p, p0, p1, p2)``."""
    key = F.col("o_orderkey")
    code = key * 7919 % 4
    o = table(spark, sf_dir, "orders").where(code < 3).select(
        key.alias("row_id"), code.cast("int").alias("nps_class")
    )
    y = (F.col("nps_class") == 0).cast("int")
    # 0.35 y + 0.65 u rounded half up to thousandths, in integers so that ties are exact
    p = F.floor((35000 * y + 65 * (F.col("row_id") * 48271 % 1000) + 50) / 100) / 1000.0
    return o.select("*", y.alias("y"), p.alias("p")).select(
        "*",
        F.col("p").alias("p0"),
        ((1 - F.col("p")) * 0.4).alias("p1"),
        ((1 - F.col("p")) * 0.6).alias("p2"),
    )


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order features with the severity flag and a learnable 0/1 label."""
    f = add_severe_flag(features(spark, sf_dir), SEVERE_DAYS, DELAY, FLAG)
    truth = F.coalesce(F.col("delay_days") > 365, F.lit(False)) | F.coalesce(
        F.col("qty_sum") > 150, F.lit(False)
    )
    flipped = F.col("row_id") * 48271 % 10 == 0
    return f.withColumn("label", (truth != flipped).cast("int")).drop("nps_class")


MODEL_META = ["row_id", "cust_id", "obs_date"]

