"""Profile queries: missingness, distributions, comparisons, cohorts, cross-tabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewide.functions import columns as C
from pulsewide.operators import profile as P
from pulsewide.operators.ordering import column_percentiles
from pulsewide.operators.split import oot_split, sample_rows
from pulsewide.plans import views as V
from pulsewide.plans.catalog.ingest import _OOT
from pulsewide.plans.catalog.registry import FEATURES, SCORED, TOKENS, WIDE, query, r, rounded, stacked

_NUM = V.NUMERIC_FEATURES
_CODES = [0, 1, 2]


def _null_counts_sql(table, cols):
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS driver, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null, count(*) AS n_rows FROM {table}"
        for c in cols
    )


_WIDE_NULLS = f"{WIDE}, nulls AS (\n  {_null_counts_sql('wide', V.KEYS)})"
_FEATURE_NULLS = f"{FEATURES}, nulls AS (\n  {_null_counts_sql('order_features', _NUM)})"


@query("a1_null_rates", f"""
WITH {_WIDE_NULLS}
SELECT driver, n_null, n_rows, {r('n_null * 100.0 / n_rows', 'pct_null')} FROM nulls""")
def a1_null_rates(spark, sf_dir):
    return rounded(P.null_counts(V.wide(spark, sf_dir), V.KEYS), "pct_null")


@query("a2_sparsity", f"""
WITH {_WIDE_NULLS}
SELECT CAST(sum(n_null) AS BIGINT) AS n_null, CAST(sum(n_rows) AS BIGINT) AS n_cells,
       {r('sum(n_null) * 100.0 / sum(n_rows)', 'pct_null')} FROM nulls""")
def a2_sparsity(spark, sf_dir):
    return rounded(P.sparsity(V.wide(spark, sf_dir), V.KEYS), "pct_null")


@query("a3_tiers", f"""
WITH {WIDE}, joined AS (SELECT *, 1 AS always, nullif(1, 1) AS never FROM wide),
nulls AS ({_null_counts_sql('joined', [*V.KEYS, 'always', 'never'])}),
p AS (SELECT n_null * 100.0 / n_rows AS pct FROM nulls)
SELECT CASE WHEN pct > 90 THEN 'Extreme (>90%)' WHEN pct >= 50 THEN 'High (50–90%)'
            WHEN pct >= 10 THEN 'Moderate (10–50%)' ELSE 'Low (<10%)' END AS tier, count(*) AS n_features
FROM p GROUP BY 1""")
def a3_tiers(spark, sf_dir):
    w = V.wide(spark, sf_dir).withColumns({"always": F.lit(1), "never": F.lit(None).cast("int")})
    return P.sparsity_tiers(w, [*V.KEYS, "always", "never"])


@query("a4_cohort_nulls", f"""
WITH {WIDE}, cohort AS (SELECT * FROM wide WHERE click IS NULL),
nulls AS ({_null_counts_sql('cohort', V.KEYS)})
SELECT driver, n_null, n_rows, {r('n_null * 100.0 / n_rows', 'pct_null')} FROM nulls""")
def a4_cohort_nulls(spark, sf_dir):
    cohort = V.wide(spark, sf_dir).where(F.col("click").isNull())
    return rounded(P.null_counts(cohort, V.KEYS), "pct_null")


@query("a5_numeric_profile", f"""
WITH {FEATURES}, f AS (SELECT *, CAST(NULL AS DOUBLE) AS never FROM order_features),
cells AS ({stacked('f', [*_NUM, 'never'])}),
names AS (SELECT unnest([{', '.join(f"'{c}'" for c in [*_NUM, 'never'])}]) AS col)
SELECT names.col AS "column", count(v) AS n, {r('min(v)', 'min')}, {r('max(v)', 'max')},
       {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.5)', 'median')}
FROM names LEFT JOIN cells ON names.col = cells.col GROUP BY names.col""")
def a5_numeric_profile(spark, sf_dir):
    f = V.features(spark, sf_dir).withColumn("never", F.lit(None).cast("double"))
    return rounded(P.numeric_profile(f, [*_NUM, "never"]), "min", "max", "mean", "median")


_TEXT = ["priority", "status", "cust_id"]


def _levels_sql(table="order_features"):
    return "levels AS (SELECT col, v, count(*) AS n FROM (" + stacked(table, _TEXT, cast="VARCHAR") + ") GROUP BY col, v)"


@query("a6_cat_profile", f"""
WITH {FEATURES}, {_levels_sql()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS rk FROM levels)
SELECT col AS "column", count(*) AS n_distinct,
       string_agg(v, '|' ORDER BY v) FILTER (WHERE rk <= 8) AS preview
FROM ranked GROUP BY col""")
def a6_cat_profile(spark, sf_dir):
    return P.categorical_profile(V.orders(spark, sf_dir), _TEXT)


@query("l3_top_levels", f"""
WITH {FEATURES}, {_levels_sql()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rk FROM levels)
SELECT col AS "column", v AS level, n, CAST(rk AS INTEGER) AS rank FROM ranked WHERE rk <= 8""")
def l3_top_levels(spark, sf_dir):
    return P.top_levels(V.orders(spark, sf_dir), _TEXT, 8)


@query("l3_sparsest", f"""
WITH {_FEATURE_NULLS}
SELECT driver, n_null, n_rows, {r('n_null * 100.0 / n_rows', 'pct_null')} FROM nulls
ORDER BY n_null * 1.0 / n_rows DESC, driver LIMIT 5""")
def l3_sparsest(spark, sf_dir):
    return rounded(P.sparsest(V.order_features(spark, sf_dir), _NUM, 5), "pct_null")


@query("a7_class_share", f"""
WITH {WIDE}
SELECT nps_class, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'share_pct')}
FROM wide GROUP BY nps_class""")
def a7_class_share(spark, sf_dir):
    return rounded(P.shares(V.wide(spark, sf_dir), "nps_class"), "share_pct")


@query("a18_label_balance", f"""
WITH {FEATURES}
SELECT CAST(CASE WHEN nps_class = 0 THEN 1 ELSE 0 END AS TINYINT) AS label, count(*) AS n,
       {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'share_pct')}
FROM order_features GROUP BY 1""")
def a18_label_balance(spark, sf_dir):
    labelled = V.orders(spark, sf_dir).select(C.is_detractor(F.col("nps_class")).alias("label"))
    return rounded(P.shares(labelled, "label"), "share_pct")


_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("a8_percentiles", f"""
WITH {FEATURES}, cells AS ({stacked('order_features', _NUM)}),
probs AS (SELECT CAST(unnest({_PROBS}) AS DOUBLE) AS prob),
q AS (SELECT col, quantile_cont(v, {_PROBS}) AS qs FROM cells GROUP BY col)
SELECT col AS "column", CAST(unnest({_PROBS}) AS DOUBLE) AS prob, round(unnest(qs), 6) + 0 AS quantile FROM q""")
def a8_percentiles(spark, sf_dir):
    return rounded(column_percentiles(V.features(spark, sf_dir), _NUM, _PROBS), "quantile")


_PAIR = ["total_price", "delay_days"]
_POPS = f"""{FEATURES}, {_OOT},
cells AS (SELECT CASE WHEN is_train THEN 'first' ELSE 'second' END AS population, col, v FROM (
  {stacked('parted', _PAIR, keep='is_train')}))"""


def _populations(spark, sf_dir):
    return oot_split(V.features(spark, sf_dir), "obs_date", ["row_id"])


@query("a9_pop_compare", f"""
WITH {_POPS},
s AS (SELECT col, population, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS std,
             quantile_cont(v, 0.95) AS p95 FROM cells GROUP BY ALL),
long AS (UNPIVOT s ON mean, median, std, p95 INTO NAME stat VALUE val),
both_sides AS (SELECT col, stat, max(val) FILTER (WHERE population = 'first') AS a,
                      max(val) FILTER (WHERE population = 'second') AS b FROM long GROUP BY ALL)
SELECT col AS "column", stat, {r('a', 'first')}, {r('b', 'second')}, {r('abs(a - b)', 'abs_diff')} FROM both_sides""")
def a9_pop_compare(spark, sf_dir):
    return rounded(P.compare_populations(*_populations(spark, sf_dir), _PAIR), "first", "second", "abs_diff")


_BOUNDS = _POPS + """,
limits AS (SELECT col, min(lo) AS lo, max(hi) AS hi FROM (
  SELECT col, population, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM cells GROUP BY ALL) GROUP BY col),
kept AS (SELECT cells.* FROM cells JOIN limits USING (col) WHERE v BETWEEN lo AND hi)"""


@query("a10_mean_shift", f"""
WITH {_BOUNDS},
m AS (SELECT col, avg(v) FILTER (WHERE population = 'first') AS a, avg(v) FILTER (WHERE population = 'second') AS b
      FROM kept GROUP BY col)
SELECT col AS "column", {r('a', 'mean_first')}, {r('b', 'mean_second')}, {r('abs(a - b)', 'delta')},
       {r('abs(a - b) / (abs(b) + 1e-9) * 100', 'relative_pct')}
FROM m""")
def a10_mean_shift(spark, sf_dir):
    shift = P.mean_shift(*_populations(spark, sf_dir), _PAIR)
    return rounded(shift, "mean_first", "mean_second", "delta", "relative_pct")


@query("p19_joint_trim", f"""
WITH {_BOUNDS}
SELECT population, count(*) AS n, {r('min(v)', 'lowest')}, {r('max(v)', 'highest')}
FROM kept WHERE col = 'delay_days' GROUP BY population""")
def p19_joint_trim(spark, sf_dir):
    first, second = P.joint_trim(_populations(spark, sf_dir), "delay_days")
    x = F.col("delay_days")
    both = first.select(F.lit("first").alias("population"), x).unionByName(
        second.select(F.lit("second").alias("population"), x)
    )
    out = both.groupBy("population").agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("lowest"), F.max(x).alias("highest")
    )
    return rounded(out, "lowest", "highest")


@query("p18_trim", f"""
WITH {FEATURES}, b AS (SELECT quantile_cont(total_price, 0.01) AS lo, quantile_cont(total_price, 0.99) AS hi FROM order_features)
SELECT row_id, total_price FROM order_features, b WHERE total_price BETWEEN lo AND hi""")
def p18_trim(spark, sf_dir):
    return P.trim(V.orders(spark, sf_dir).select("row_id", "total_price"), "total_price")


@query("a11_max_dev", f"""
WITH {WIDE}, s AS (SELECT unnest([0, 1, 2]) AS c),
p AS (SELECT c, (SELECT count(*) FROM wide WHERE nps_class = c) * 100.0 / (SELECT count(*) FROM wide) AS share FROM s)
SELECT {r('max(abs(CAST(share AS DOUBLE) - CAST(100 AS DOUBLE) / 3))', 'max_deviation_pp')} FROM p""")
def a11_max_dev(spark, sf_dir):
    return rounded(P.max_deviation(V.wide(spark, sf_dir), "nps_class", _CODES), "max_deviation_pp")


@query("a12_zero_var", f"""
WITH {FEATURES}, cells AS ({stacked('order_features', _NUM)})
SELECT col AS "column", {r('stddev_samp(v)', 'std')}, (min(v) = max(v) AND count(v) > 1) AS is_constant
FROM cells GROUP BY col""")
def a12_zero_var(spark, sf_dir):
    return rounded(P.zero_variance(V.order_features(spark, sf_dir), _NUM), "std")


def _hist_sql(cte, table, col, bins):
    return f"""
WITH {cte}, lim AS (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {table}),
b AS (SELECT least(CAST(floor((CAST({col} AS DOUBLE) - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
      FROM {table}, lim WHERE {col} IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS BIGINT) AS bin FROM range({bins}))
SELECT g.bin, {r(f'lo + g.bin * ((hi - lo) / {bins})', 'lo')}, {r(f'lo + (g.bin + 1) * ((hi - lo) / {bins})', 'hi')},
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM g CROSS JOIN lim LEFT JOIN b ON g.bin = b.bin"""


@query("a13_histogram", _hist_sql(FEATURES, "order_features", "delay_days", 40))
def a13_histogram(spark, sf_dir):
    return rounded(P.histogram(V.features(spark, sf_dir), "delay_days", 40), "lo", "hi")


@query("a13_score_histogram", _hist_sql(SCORED, "scored", "p", 80))
def a13_score_histogram(spark, sf_dir):
    return rounded(P.histogram(V.scored(spark, sf_dir), "p", 80), "lo", "hi")


_QCUT = f"""{FEATURES}, rows_used AS (
  SELECT delay_days AS x, nps_class FROM order_features WHERE delay_days IS NOT NULL AND nps_class IN (0, 1, 2)),
edges AS (SELECT e, row_number() OVER (ORDER BY e) - 2 AS bin FROM (
  SELECT DISTINCT unnest(quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) AS e FROM rows_used)),
bins AS (SELECT hi.bin, lo.e AS lo, hi.e AS hi FROM edges hi JOIN edges lo ON lo.bin = hi.bin - 1),
tab AS (
  SELECT CAST(bin AS INTEGER) AS bin, any_value(lo) AS lo, any_value(hi) AS hi,
         count_if(nps_class = 0) AS class_0, count_if(nps_class = 1) AS class_1, count_if(nps_class = 2) AS class_2,
         count(*) AS total
  FROM rows_used JOIN bins ON (x > lo OR (bin = 0 AND x = lo)) AND x <= hi GROUP BY bin)"""


@query("a14_qcut_mix", f"""
WITH {_QCUT}
SELECT bin, {r('lo', 'lo')}, {r('hi', 'hi')}, format('{{:.0f}}–{{:.0f}} min', round(lo), round(hi)) AS label,
       CAST(class_0 AS BIGINT) AS class_0, CAST(class_1 AS BIGINT) AS class_1, CAST(class_2 AS BIGINT) AS class_2, total
FROM tab""")
def a14_qcut_mix(spark, sf_dir):
    return rounded(P.quantile_class_mix(V.features(spark, sf_dir), "delay_days", "nps_class", _CODES), "lo", "hi")


@query("r5_row_pct", f"""
WITH {_QCUT}
SELECT bin, {r('class_0 * 100.0 / total', 'class_0_pct')}, {r('class_1 * 100.0 / total', 'class_1_pct')},
       {r('class_2 * 100.0 / total', 'class_2_pct')} FROM tab""")
def r5_row_pct(spark, sf_dir):
    table = P.quantile_class_mix(V.features(spark, sf_dir), "delay_days", "nps_class", _CODES)
    pct = [f"class_{c}_pct" for c in _CODES]
    return rounded(P.row_percent(table, [f"class_{c}" for c in _CODES]).select("bin", *pct), *pct)


@query("r4_crosstab", f"""
WITH {FEATURES}
SELECT priority, CAST(count_if(nps_class = 0) AS BIGINT) AS class_0, CAST(count_if(nps_class = 1) AS BIGINT) AS class_1,
       CAST(count_if(nps_class = 2) AS BIGINT) AS class_2, CAST(count_if(nps_class IN (0, 1, 2)) AS BIGINT) AS total
FROM order_features GROUP BY priority""")
def r4_crosstab(spark, sf_dir):
    return P.cross_tab(V.orders(spark, sf_dir), "priority", "nps_class", _CODES)


@query("r3_unpivot", f"""
WITH {WIDE}, nulls AS ({_null_counts_sql('wide', V.KEYS)})
SELECT driver, {r('n_null * 100.0 / n_rows', 'pct_null')} FROM nulls""")
def r3_unpivot(spark, sf_dir):
    w = V.wide(spark, sf_dir)
    one = w.agg(*[(F.count_if(F.col(k).isNull()) * 100.0 / F.count(F.lit(1))).alias(k) for k in V.KEYS])
    return rounded(P.transpose_row(one, "driver", "pct_null"), "pct_null")


@query("a15_exposure", f"""
WITH {FEATURES}, {_OOT}
SELECT CASE WHEN is_train THEN 'train' ELSE 'live' END AS population,
       {r('count_if(delay_days > 365) * 100.0 / count(*)', 'pct_severe')},
       {r('count_if(delay_days <= 365) * 100.0 / count(*)', 'pct_normal')},
       {r('count_if(delay_days IS NULL) * 100.0 / count(*)', 'pct_missing')}
FROM parted GROUP BY is_train""")
def a15_exposure(spark, sf_dir):
    older, newer = _populations(spark, sf_dir)
    out = P.exposure({"train": older, "live": newer}, "delay_days", V.SEVERE_DAYS)
    return rounded(out, "pct_severe", "pct_normal", "pct_missing")


@query("a16_split_dates", f"""
WITH {FEATURES}, {_OOT}
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, count(*) AS n,
       min(obs_date) AS first_date, max(obs_date) AS last_date
FROM parted GROUP BY is_train""")
def a16_split_dates(spark, sf_dir):
    older, newer = _populations(spark, sf_dir)
    both = older.withColumn("part", F.lit("train")).unionByName(newer.withColumn("part", F.lit("test")))
    return P.date_ranges(both, "part", "obs_date")


@query("a17_kde", f"""
WITH {_BOUNDS},
used AS (SELECT population, v FROM kept WHERE col = 'delay_days'),
s AS (SELECT population, count(*) AS n, min(v) AS lo, max(v) AS hi,
             stddev_samp(v) * pow(count(*), CAST(-0.2 AS DOUBLE)) AS h FROM used GROUP BY population),
g AS (SELECT population, n, h, CAST(k AS INTEGER) AS k, lo - 3 * h + k * ((hi - lo + 6 * h) / 199) AS x
      FROM s, (SELECT range AS k FROM range(200))),
w AS (SELECT population, v, count(*) AS c FROM used GROUP BY ALL)
SELECT g.population, k, {r('any_value(x)', 'x')},
       round(sum(c * exp(CAST(-0.5 AS DOUBLE) * ((x - v) / h) * ((x - v) / h)))
             / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) + 0 AS density
FROM g JOIN w ON g.population = w.population GROUP BY g.population, k""")
def a17_kde(spark, sf_dir):
    first, second = P.joint_trim(_populations(spark, sf_dir), "delay_days")
    out = P.kernel_density({"first": first, "second": second}, "delay_days")
    return rounded(rounded(out, "x"), "density", digits=9)


@query("a19_score_summary", f"""
WITH {SCORED}, e AS (SELECT (p2 - p0) * 100 AS s FROM scored)
SELECT 'expected_score' AS "column", {r('avg(s)', 'mean')}, {r('quantile_cont(s, 0.5)', 'median')},
       {r('stddev_samp(s)', 'std')}, {r('min(s)', 'min')}, {r('max(s)', 'max')} FROM e""")
def a19_score_summary(spark, sf_dir):
    e = V.scored(spark, sf_dir).select(C.expected_score(F.col("p2"), F.col("p0")).alias("expected_score"))
    return rounded(P.score_summary(e, "expected_score"), "mean", "median", "std", "min", "max")


@query("a20_null_rate", f"""
WITH {_FEATURE_NULLS}
SELECT CAST(sum(n_null) AS BIGINT) AS n_null, CAST(sum(n_rows) AS BIGINT) AS n_cells,
       {r('sum(n_null) * 100.0 / sum(n_rows)', 'pct_null')} FROM nulls""")
def a20_null_rate(spark, sf_dir):
    return rounded(P.sparsity(V.order_features(spark, sf_dir), _NUM), "pct_null")


@query("a21_cohorts", f"""
WITH {WIDE}, c AS (
  SELECT CASE WHEN coalesce(error, purchase, signup, view) IS NOT NULL THEN 'partial' ELSE 'pure_inactive' END AS cohort
  FROM wide WHERE click IS NULL)
SELECT cohort, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'share_pct')} FROM c GROUP BY cohort""")
def a21_cohorts(spark, sf_dir):
    inactive = V.wide(spark, sf_dir).where(F.col("click").isNull())
    return rounded(P.cohorts(inactive, V.KEYS), "share_pct")


@query("a22_baselines", f"""
WITH {SCORED}, b AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM scored)
SELECT {r('p', 'base_rate')}, {r('-(p * ln(p) + (1 - p) * ln(1 - p))', 'naive_logloss')}, {r('ln(3)', 'uniform_logloss')} FROM b""")
def a22_baselines(spark, sf_dir):
    return rounded(P.base_rate(V.scored(spark, sf_dir), "y"), "base_rate", "naive_logloss", "uniform_logloss")


@query("l6_extremes", f"""
WITH {SCORED},
hi AS (SELECT row_id, p FROM scored ORDER BY p DESC, row_id LIMIT 1),
lo AS (SELECT row_id, p FROM scored ORDER BY p, row_id LIMIT 1)
SELECT 'high' AS who, row_id, p, p > CAST(0.9 AS DOUBLE) AS passes FROM hi
UNION ALL SELECT 'low', row_id, p, p < CAST(0.1 AS DOUBLE) FROM lo""")
def l6_extremes(spark, sf_dir):
    return P.extremes(V.scored(spark, sf_dir), "p", "row_id")


@query("l6_extremes_text", f"""
WITH {SCORED}, named AS (SELECT 'row ' || row_id AS name, p FROM scored),
hi AS (SELECT name, p FROM named ORDER BY p DESC, name LIMIT 1),
lo AS (SELECT name, p FROM named ORDER BY p, name LIMIT 1)
SELECT 'high' AS who, name, p, p > CAST(0.9 AS DOUBLE) AS passes FROM hi
UNION ALL SELECT 'low', name, p, p < CAST(0.1 AS DOUBLE) FROM lo""")
def l6_extremes_text(spark, sf_dir):
    """The same with a text id, as customers have."""
    named = V.scored(spark, sf_dir).select(F.concat(F.lit("row "), "row_id").alias("name"), "p")
    return P.extremes(named, "p", "name")


@query("l9_preview", f"""
WITH {WIDE}, halves AS (
  SELECT CASE WHEN coalesce(error, purchase, signup, view) IS NOT NULL THEN 'partial' ELSE 'pure_inactive' END AS cohort,
         entity_id, obs_date, purchase, view,
         row_number() OVER (PARTITION BY coalesce(error, purchase, signup, view) IS NOT NULL
           ORDER BY CAST('0x' || substr(md5('42|' || entity_id || '|' || strftime(obs_date, '%Y-%m-%d') || '|' || score), 1, 15) AS BIGINT)) AS k
  FROM wide WHERE click IS NULL AND obs_date IS NOT NULL AND score IS NOT NULL)
SELECT cohort, entity_id, obs_date, purchase, view FROM halves WHERE k <= 5""")
def l9_preview(spark, sf_dir):
    """Five seeded rows of each half of the inactive cohort, wanted columns that exist."""
    w = V.wide(spark, sf_dir).where("click is null and obs_date is not null and score is not null")
    shown = P.present_only(w, ["entity_id", "obs_date", "absent", "purchase", "view"])
    idle, partial = P.split_by_activity(w, [k for k in V.KEYS if k != "click"])
    parts = [
        sample_rows(half, ["entity_id", "obs_date", "score"], 5).select(F.lit(name).alias("cohort"), *shown)
        for name, half in (("pure_inactive", idle), ("partial", partial))
    ]
    return parts[0].unionByName(parts[1])


_TRIMMED = f"""{FEATURES}, cut AS (
  SELECT quantile_cont(delay_days, 0.01) AS a, quantile_cont(delay_days, 0.99) AS b FROM order_features),
trimmed AS (SELECT delay_days FROM order_features, cut WHERE delay_days BETWEEN a AND b)"""


@query("a13_trimmed_histogram", f"""
SELECT h.*, (WITH {_TRIMMED} SELECT {r('quantile_cont(delay_days, 0.5)', 'm')[:-5]} FROM trimmed) AS median
FROM ({_hist_sql(_TRIMMED, "trimmed", "delay_days", 40)}) h""")
def a13_trimmed_histogram(spark, sf_dir):
    """Values inside their 1st and 99th percentile, in bins, with the median of those kept."""
    kept = P.trim(V.features(spark, sf_dir), "delay_days")
    median = P.percentile_map(kept, ["delay_days"], [0.5])["delay_days"][0]
    return rounded(P.histogram(kept, "delay_days", 40).withColumn("median", F.lit(median)), "lo", "hi", "median")


@query("a6_token_levels", f"""
WITH {TOKENS}
SELECT 'tokens' AS "column", tokens AS level, count(*) AS n FROM part_tokens WHERE tokens IS NOT NULL GROUP BY tokens""")
def a6_token_levels(spark, sf_dir):
    return P.level_counts(V.part_tokens(spark, sf_dir), ["tokens"])
