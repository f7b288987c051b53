"""Ingest queries: pivot, casts, labels, flag, active history."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from pulsewide.functions import columns as C
from pulsewide.operators import profile as P
from pulsewide.operators.encode import drop_redundant
from pulsewide.operators.matrix import align, align_categories, category_domain, zero_out
from pulsewide.operators.matrix import Layout
from pulsewide import schema as S
from pulsewide.operators.encode import Vocabulary
from pulsewide.operators.pivot import active_history, cast_drivers, load_wide
from pulsewide.operators.split import oot_split
from pulsewide.plans import views as V
from pulsewide.plans.flows import live_features, train_features
from pulsewide.plans.catalog.registry import EAV, FEATURES, WIDE, _DECIMAL, query, r, rounded
from pulsewide.session import scratch_path
from pulsewide.sources.eav import read_csv, read_definitions

CLICK_SEVERE = 5000.0


@query("r1_pivot_first", f"WITH {WIDE} SELECT * FROM wide")
def r1_pivot_first(spark, sf_dir):
    return V.wide(spark, sf_dir)


@query("p1_p2_cast", rf"""
WITH {EAV}
SELECT ord, nullif(raw_value, '') AS text_value,
       CASE WHEN regexp_full_match(raw_value, '{_DECIMAL}') THEN TRY_CAST(raw_value AS FLOAT) END AS number_value
FROM eav""")
def p1_p2_cast(spark, sf_dir):
    e = V.eav(spark, sf_dir).select("ord", F.col("raw_value").alias("text_value"), F.col("raw_value").alias("number_value"))
    return cast_drivers(e, {"text_value": "categorical", "number_value": "numeric"})


@query("p5_date", f"""
WITH {EAV}
SELECT CAST(try_strptime(substr(obs_date_raw, 1, 10), '%Y-%m-%d') AS DATE) AS obs_date, count(*) AS n
FROM eav GROUP BY 1""")
def p5_date(spark, sf_dir):
    dated = V.eav(spark, sf_dir).select(C.to_date(F.col("obs_date_raw")).alias("obs_date"))
    return dated.groupBy("obs_date").agg(F.count(F.lit(1)).alias("n"))


@query("p6_score_cast", f"""
WITH {EAV}
SELECT ord, TRY_CAST(score_raw AS TINYINT) AS score,
       CASE WHEN regexp_full_match(raw_value, '[+-]?[0-9]+') THEN TRY_CAST(raw_value AS TINYINT) END AS small_value
FROM eav""")
def p6_score_cast(spark, sf_dir):
    return V.eav(spark, sf_dir).select(
        "ord", C.to_tiny(F.col("score_raw")).alias("score"), C.to_tiny(F.col("raw_value")).alias("small_value")
    )


@query("p7_class", f"WITH {WIDE} SELECT entity_id, obs_date, score, nps_class FROM wide")
def p7_class(spark, sf_dir):
    return V.wide(spark, sf_dir).select("entity_id", "obs_date", "score", "nps_class")


_FLAG = "CAST(CASE WHEN click IS NULL THEN NULL WHEN click > 5000 THEN 1 ELSE 0 END AS TINYINT)"


@query("p8_flag", f"WITH {WIDE} SELECT entity_id, obs_date, click, {_FLAG} AS is_severe FROM wide")
def p8_flag(spark, sf_dir):
    return V.wide(spark, sf_dir).select(
        "entity_id", "obs_date", "click", C.severe_flag(F.col("click"), CLICK_SEVERE).alias("is_severe")
    )


@query("p9_flag_counts", f"""
WITH {WIDE}, f AS (SELECT {_FLAG} AS flag FROM wide),
c AS (SELECT count(*) AS total, count_if(flag = 1) AS severe, count_if(flag = 0) AS normal,
             count_if(flag IS NULL) AS missing FROM f)
SELECT state, CAST(n AS BIGINT) AS n, {r('n * 100.0 / total', 'share_pct')} FROM (
  SELECT 'severe' AS state, severe AS n, total FROM c
  UNION ALL SELECT 'normal', normal, total FROM c
  UNION ALL SELECT 'missing', missing, total FROM c)""")
def p9_flag_counts(spark, sf_dir):
    flagged = V.wide(spark, sf_dir).select(C.severe_flag(F.col("click"), CLICK_SEVERE).alias("flag"))
    return rounded(P.flag_counts(flagged, "flag"), "share_pct")


@query("p10_semantic_drop", f"""
WITH {FEATURES}
SELECT row_id, cust_id, obs_date, priority, status, total_price, {r('delay_days', 'delay_days')},
       {r('qty_sum', 'qty_sum')}, {r('price_sum', 'price_sum')}, {r('disc_avg', 'disc_avg')}, n_lines,
       const_col, nps_class
FROM order_features""")
def p10_semantic_drop(spark, sf_dir):
    kept, _ = drop_redundant(V.order_features(spark, sf_dir), {"price_alias": "price_sum", "not_there": "x"})
    return rounded(kept, "delay_days", "qty_sum", "price_sum", "disc_avg")


@query("p14_name_selection", f"WITH {WIDE} SELECT entity_id, obs_date, error, purchase, view FROM wide")
def p14_name_selection(spark, sf_dir):
    """Columns chosen by name part, then a present-only list without repeats."""
    w = V.wide(spark, sf_dir)
    found = P.columns_with(w.columns, "err", "view", "purch")
    return w.select(*P.present_only(w, ["entity_id", "obs_date", *found, "entity_id", "absent"]))


@query("p15_filter", f"""
WITH {WIDE} SELECT click, nps_class FROM wide WHERE click IS NOT NULL AND nps_class IN (0, 1, 2)""")
def p15_filter(spark, sf_dir):
    w = V.wide(spark, sf_dir)
    return w.where(F.col("click").isNotNull() & F.col("nps_class").isin(0, 1, 2)).select("click", "nps_class")


@query("p17_any_not_null", f"""
WITH {WIDE}
SELECT entity_id, obs_date,
       (click IS NOT NULL OR error IS NOT NULL OR purchase IS NOT NULL OR signup IS NOT NULL OR view IS NOT NULL) AS active
FROM wide""")
def p17_any_not_null(spark, sf_dir):
    return V.wide(spark, sf_dir).select("entity_id", "obs_date", C.any_not_null(V.KEYS).alias("active"))


@query("p20_binary_label", f"""
WITH {FEATURES} SELECT row_id, CAST(CASE WHEN nps_class = 0 THEN 1 ELSE 0 END AS TINYINT) AS label FROM order_features""")
def p20_binary_label(spark, sf_dir):
    return V.orders(spark, sf_dir).select("row_id", C.is_detractor(F.col("nps_class")).alias("label"))


@query("p23_zero_out", f"""
WITH {FEATURES}
SELECT row_id, total_price, CAST(0 AS DOUBLE) AS delay_days, {r('qty_sum', 'qty_sum')}, CAST(0 AS BIGINT) AS n_lines
FROM order_features""")
def p23_zero_out(spark, sf_dir):
    f = V.order_features(spark, sf_dir).select("row_id", "total_price", "delay_days", "qty_sum", "n_lines")
    changed, _ = zero_out(f, ["delay_days", "n_lines", "not_there"])
    return rounded(changed, "qty_sum")


@query("p24_align", f"""
WITH {FEATURES}
SELECT row_id, {r('qty_sum', 'qty_sum')}, CAST(NULL AS DOUBLE) AS added_later, priority FROM order_features""")
def p24_align(spark, sf_dir):
    layout = Layout(["row_id", "qty_sum", "added_later", "priority"], ["bigint", "double", "double", "string"], [], 0)
    return rounded(align(V.order_features(spark, sf_dir), layout), "qty_sum")


_OOT = """ordered AS (
  SELECT *, row_number() OVER (ORDER BY obs_date, row_id) AS rn, count(*) OVER () AS n FROM order_features),
parted AS (
  SELECT *, rn <= CAST(floor(CAST(n AS DOUBLE) * (CAST(1.0 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS BIGINT) AS is_train
  FROM ordered)"""


@query("p25_categories", f"""
WITH {FEATURES}, {_OOT},
m AS (SELECT row_id, is_train, strftime(obs_date, '%Y-%m') AS month FROM parted)
SELECT row_id, CASE WHEN month IN (SELECT month FROM m WHERE is_train) THEN month END AS month
FROM m WHERE NOT is_train""")
def p25_categories(spark, sf_dir):
    """Newer rows keep only the months the older rows know."""
    f = V.orders(spark, sf_dir).select(
        "row_id", "obs_date", F.date_format("obs_date", "yyyy-MM").alias("month")
    )
    older, newer = oot_split(f, "obs_date", ["row_id"])
    return align_categories(newer.select("row_id", "month"), "month", category_domain(older, "month"))


@query("p26_p27_names", f"""
WITH {EAV}
SELECT attr_key,
       trim(replace(replace(replace(replace(replace(replace('transactional' || attr_key || 'V0Last30d',
            'transactional', ''), 'userProfile', ''), 'V0Last30d', ' (30d)'), 'V1Last30d', ' (30d)'),
            'V0Last180d', ' (180d)'), 'V0', '')) AS short_name,
       substr(replace(replace(replace(replace(replace(replace('userProfile' || attr_key || 'V0Last180d',
            'transactional', ''), 'userProfile', ''), 'V0Last30d', ' 30d'), 'V1Last30d', ' 30d'),
            'V0Last180d', ' 180d'), 'V0', ''), 1, 40) AS short_label,
       CASE WHEN score_raw = '0' THEN 'Detractor' WHEN score_raw = '7' THEN 'Passive'
            WHEN score_raw = '10' THEN 'Promoter' END AS class_name,
       count(*) AS n
FROM eav GROUP BY ALL""")
def p26_p27_names(spark, sf_dir):
    e = V.eav(spark, sf_dir)
    return e.select(
        "attr_key",
        C.short_name(F.concat(F.lit("transactional"), "attr_key", F.lit("V0Last30d"))).alias("short_name"),
        C.short_label(F.concat(F.lit("userProfile"), "attr_key", F.lit("V0Last180d"))).alias("short_label"),
        C.label_of(C.score_class(C.to_tiny(F.col("score_raw"))), C.labels_for([0, 1, 2])).alias("class_name"),
    ).groupBy("attr_key", "short_name", "short_label", "class_name").agg(F.count(F.lit(1)).alias("n"))


@query("j1_active_semi", f"""
WITH {EAV}
SELECT * FROM eav WHERE entity_id IN (SELECT entity_id FROM eav WHERE attr_key = 'click' AND raw_value <> '')""")
def j1_active_semi(spark, sf_dir):
    return active_history(V.eav(spark, sf_dir), "click", "entity_id", "attr_key", "raw_value")


@query("flagship_exposure_by_class", f"""
WITH {WIDE}
SELECT nps_class, count(*) AS n,
       {r('count_if(click > 5000) * 100.0 / count(*)', 'pct_severe')},
       {r('count_if(click <= 5000) * 100.0 / count(*)', 'pct_normal')},
       {r('count_if(click IS NULL) * 100.0 / count(*)', 'pct_missing')}
FROM wide GROUP BY nps_class""")
def flagship_exposure_by_class(spark, sf_dir):
    """From raw attribute-value rows to delay exposure by class in one shuffle plus a tiny one."""
    x = F.col("click")
    n = F.count(F.lit(1))
    out = V.wide(spark, sf_dir).groupBy("nps_class").agg(
        n.alias("n"),
        (F.count_if(x > CLICK_SEVERE) * 100.0 / n).alias("pct_severe"),
        (F.count_if(x <= CLICK_SEVERE) * 100.0 / n).alias("pct_normal"),
        (F.count_if(x.isNull()) * 100.0 / n).alias("pct_missing"),
    )
    return rounded(out, "pct_severe", "pct_normal", "pct_missing")


def _written(spark, rows, name):
    """Rows written as CSV into the shared folder; quotes and commas are quoted."""
    path = scratch_path(spark) + "/" + name
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


_TRAIN_ROWS = f"""{EAV},
train AS (
  SELECT CAST(entity_id AS VARCHAR) AS "sourceId", 'u' || entity_id AS "sourceUniqueId", obs_date_raw AS "npsDate",
         score_raw AS "npsScore", attr_key AS "driverKey", ord,
         CASE WHEN ord % 3 = 0 THEN raw_value || ', "' || attr_key || '"' ELSE raw_value END AS value
  FROM eav)"""


def _train_rows(spark, sf_dir):
    """The raw rows under their input names, some values with quotes and commas."""
    e = V.eav(spark, sf_dir)
    quoted = F.concat("raw_value", F.lit(', "'), "attr_key", F.lit('"'))
    return e.select(
        F.col("entity_id").cast("string").alias("sourceId"), F.concat(F.lit("u"), "entity_id").alias("sourceUniqueId"),
        F.col("obs_date_raw").alias("npsDate"), F.col("score_raw").alias("npsScore"), F.col("attr_key").alias("driverKey"),
        F.when(F.col("ord") % 3 == 0, quoted).otherwise(F.col("raw_value")).alias("value"),
        "ord",
    )


@query("s1_csv_round_trip", f"""
WITH {_TRAIN_ROWS}
SELECT "sourceId", "npsScore", "driverKey", nullif(value, '') AS value, count(*) AS n FROM train GROUP BY ALL""")
def s1_csv_round_trip(spark, sf_dir):
    """Every raw row written as CSV and read back, quotes and commas included."""
    path = _written(spark, _train_rows(spark, sf_dir).drop("ord"), "train")
    back = read_csv(spark, path)
    value = F.when(F.col("value") != "", F.col("value"))
    return back.groupBy("sourceId", "npsScore", "driverKey", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("s1_csv_pivot", f"""
WITH {_TRAIN_ROWS},
first_values AS (
  SELECT "sourceId", "npsDate", "npsScore", arg_min_null(value, ord) FILTER (WHERE "driverKey" = 'click') AS click,
         arg_min_null(value, ord) FILTER (WHERE "driverKey" = 'view') AS view FROM train GROUP BY ALL)
SELECT "sourceId", CAST(try_strptime(substr("npsDate", 1, 10), '%Y-%m-%d') AS DATE) AS "npsDate",
       TRY_CAST("npsScore" AS TINYINT) AS "npsScore", nullif(click, '') AS click, nullif(view, '') AS view
FROM first_values""")
def s1_csv_pivot(spark, sf_dir):
    """First values by the row order of several CSV files."""
    rows = _train_rows(spark, sf_dir).repartitionByRange(4, "ord").sortWithinPartitions("ord").drop("ord")
    raw = read_csv(spark, _written(spark, rows, "ordered"))
    return load_wide(raw, {"click": "categorical", "view": "categorical"}).drop("sourceUniqueId")


@query("s3_definitions", f"""
WITH {EAV}
SELECT attr_key AS key, CASE attr_key WHEN 'click' THEN 'numeric' WHEN 'view' THEN 'categorical'
       WHEN 'error' THEN 'multi_categorical' END AS data_type
FROM eav WHERE attr_key IN ('click', 'view', 'error') GROUP BY ALL""")
def s3_definitions(spark, sf_dir):
    """Definitions written from the attributes and read back; unknown types are left out."""
    kind = (
        F.when(F.col("attr_key") == "click", "numeric").when(F.col("attr_key") == "view", "categorical")
        .when(F.col("attr_key") == "error", "multi_categorical").otherwise("blob")
    )
    rows = V.eav(spark, sf_dir).select(F.col("attr_key").alias("key"), F.lit("a, \"b\"").alias("driverType"), kind.alias("dataType")).distinct()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the unknown ones are meant
        types, _ = read_definitions(spark, _written(spark, rows, "definitions"))
    return spark.createDataFrame(sorted(types.items()), "key string, data_type string")


_FLOW_TYPES = {k: "numeric" for k in V.KEYS}


@query("flow_train_columns", f"""
WITH {WIDE} SELECT count(*) AS n_rows, count(click) AS n_click, CAST(count_if(click > 5000) AS BIGINT) AS n_severe,
       'click,error,is_severe_delay_10m_plus,nps_class,npsDate,npsScore,purchase,signup,sourceId,sourceUniqueId,view' AS columns
FROM wide""")
def flow_train_columns(spark, sf_dir):
    """Rows and columns of the training features, from raw rows through the whole flow."""
    raw = _flow_rows(spark, sf_dir)
    found = train_features(raw, {**{k: t for k, t in _FLOW_TYPES.items() if k != "click"}, S.DELAY_COL: "numeric"}, threshold=0.999)
    table = found.table.withColumnRenamed(S.DELAY_COL, "click")
    names = ",".join(sorted(table.columns, key=str.lower))
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("click").alias("n_click"),
        F.count_if(F.col("click") > CLICK_SEVERE).alias("n_severe"), F.lit(names).alias("columns"),
    )


def _flow_rows(spark, sf_dir):
    """Raw rows under the input's names; clicks stand in for the delay."""
    e = V.eav(spark, sf_dir)
    return e.select(
        F.col("entity_id").cast("string").alias("sourceId"), F.concat(F.lit("u"), "entity_id").alias("sourceUniqueId"),
        F.col("obs_date_raw").alias("npsDate"), F.col("score_raw").alias("npsScore"),
        F.when(F.col("attr_key") == "click", F.lit(S.DELAY_COL)).otherwise(F.col("attr_key")).alias("driverKey"),
        F.col("raw_value").alias("value"), "ord",
    )


@query("flow_live_rows", f"""
WITH {WIDE} SELECT CAST(entity_id AS VARCHAR) AS "sourceId", obs_date AS "npsDate", click, view,
       CAST(CASE WHEN click > 10 THEN 1 ELSE 0 END AS TINYINT) AS severe
FROM wide WHERE click IS NOT NULL""")
def flow_live_rows(spark, sf_dir):
    """Live rows of active customers, through the semi-join and the pivot of the Live flow."""
    types = {**{k: t for k, t in _FLOW_TYPES.items() if k != "click"}, S.DELAY_COL: "numeric"}
    ready = live_features(_flow_rows(spark, sf_dir), types, Vocabulary((), ()))
    return ready.select("sourceId", "npsDate", F.col(S.DELAY_COL).alias("click"), "view", F.col(S.SEVERE_FLAG_COL).alias("severe"))
