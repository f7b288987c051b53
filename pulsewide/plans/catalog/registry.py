"""Registry of queries and the SQL text of the stand-in views."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"

EAV = """eav AS (
  SELECT user_id AS entity_id,
         strftime(CAST(ts AS DATE), '%Y-%m-%d') || 'T00:00:00Z' AS obs_date_raw,
         event_id AS ord,
         event_type AS attr_key,
         CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'n/a'
              ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS raw_value,
         CASE (user_id * 31 + day(CAST(ts AS DATE))) % 4
              WHEN 0 THEN '0' WHEN 1 THEN '7' WHEN 2 THEN '10' ELSE '5' END AS score_raw
  FROM events)"""

_KEY_COLUMNS = ",\n         ".join(
    f"arg_min_null(raw_value, ord) FILTER (WHERE attr_key = '{k}') AS {k}_raw" for k in V.KEYS
)
_TYPED = ",\n         ".join(
    f"CASE WHEN regexp_full_match({k}_raw, '{_DECIMAL}') THEN TRY_CAST({k}_raw AS FLOAT) END AS {k}"
    for k in V.KEYS
)
WIDE = EAV + f""",
first_values AS (
  SELECT entity_id, obs_date_raw, score_raw,
         {_KEY_COLUMNS}
  FROM eav GROUP BY entity_id, obs_date_raw, score_raw),
wide AS (
  SELECT entity_id,
         CAST(try_strptime(substr(obs_date_raw, 1, 10), '%Y-%m-%d') AS DATE) AS obs_date,
         TRY_CAST(score_raw AS TINYINT) AS score,
         {_TYPED},
         CAST(CASE TRY_CAST(score_raw AS TINYINT) WHEN 0 THEN 0 WHEN 7 THEN 1 WHEN 10 THEN 2
              ELSE -1 END AS TINYINT) AS nps_class
  FROM first_values)"""

FEATURES = """per_order AS (
  SELECT l_orderkey,
         avg(greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0)) AS delay_days,
         sum(l_quantity) AS qty_sum, round(sum(l_extendedprice), 2) AS price_sum,
         round(avg(l_discount), 9) AS disc_avg, count(*) AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
order_features AS (
  SELECT o_orderkey AS row_id, o_custkey AS cust_id, CAST(o_orderdate AS DATE) AS obs_date,
         o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS total_price,
         delay_days, qty_sum, price_sum, disc_avg, n_lines,
         CASE WHEN o_orderkey % 5 <> 0 THEN price_sum * 2 + o_orderkey % 3 END AS price_alias,
         CAST(1.0 AS DOUBLE) AS const_col,
         CASE WHEN (o_orderkey * 7919) % 4 < 3 THEN CAST((o_orderkey * 7919) % 4 AS INTEGER) ELSE -1 END AS nps_class
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey)"""

TOKENS = """part_tokens AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '||'
              WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '||') || '|| ' || replace(p_name, ' ', '||')
              ELSE replace(p_name, ' ', '||') END AS tokens
  FROM part),
token_lists AS (
  SELECT p_partkey,
         list_distinct(list_filter(list_transform(string_split(coalesce(tokens, 'NO_OPTIONS'), '||'),
                       lambda x: trim(x)), lambda x: x <> '')) AS toks
  FROM part_tokens)"""

SCORED = """labelled AS (
  SELECT o_orderkey AS row_id, CAST((o_orderkey * 7919) % 4 AS INTEGER) AS nps_class,
         CASE WHEN (o_orderkey * 7919) % 4 = 0 THEN 1 ELSE 0 END AS y
  FROM orders WHERE (o_orderkey * 7919) % 4 < 3),
scored_p AS (
  SELECT *, ((35000 * y + 65 * ((row_id * 48271) % 1000) + 50) // 100) / CAST(1000 AS DOUBLE) AS p
  FROM labelled),
scored AS (
  SELECT *, p AS p0, (1 - p) * CAST(0.4 AS DOUBLE) AS p1, (1 - p) * CAST(0.6 AS DOUBLE) AS p2 FROM scored_p)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where SQL cannot say the same."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round floating results for comparison; adding 0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0 AS {name}"


def stacked(table: str, cols: Sequence[str], keep: str = "", cast: str = "DOUBLE") -> str:
    """SQL that stacks columns into ``(keep, pos, col, v)`` without the missing values."""
    lead = f"{keep}, " if keep else ""
    return "\n  UNION ALL ".join(
        f"SELECT {lead}{i} AS pos, '{c}' AS col, CAST({c} AS {cast}) AS v FROM {table} WHERE {c} IS NOT NULL"
        for i, c in enumerate(cols)
    )

