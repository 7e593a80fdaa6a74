"""Checked queries for the per-series time operators (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewise.operators import series as S
from pricewise.plans.registry import register, rounded
from pricewise.sources.fixtures import fixture, with_fixture

BY = ["series"]

# ------------------------------------------------------------- SQL pieces
FILLED = """
, rng AS (SELECT series, min(d) AS d0, max(d) AS d1 FROM fx_daily GROUP BY series),
cal AS (SELECT series, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS d FROM rng),
filled AS (SELECT c.series, c.d, x.open, x.high, x.low FROM cal c
           LEFT JOIN fx_daily x ON c.series = x.series AND c.d = x.d),
bf AS (SELECT series, d,
         coalesce(open, first_value(open IGNORE NULLS) OVER (PARTITION BY series ORDER BY d
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS open,
         coalesce(high, first_value(high IGNORE NULLS) OVER (PARTITION BY series ORDER BY d
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS high,
         coalesce(low, first_value(low IGNORE NULLS) OVER (PARTITION BY series ORDER BY d
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS low,
         row_number() OVER (PARTITION BY series ORDER BY d) AS pos
       FROM filled)"""


def filled_daily(spark, sf_dir):
    """fx_daily -> daily calendar per series -> positions -> back fill."""
    daily = fixture(spark, sf_dir, "fx_daily")
    filled = S.fill_missing_dates(daily, BY, "d", pos="_pos")
    return S.backfill(filled, BY, "_pos", ["open", "high", "low"])


@register("f01_fill_missing_dates", with_fixture("fx_daily", FILLED + """
SELECT series, d, round(open, 6) AS open FROM filled"""))
def q_fill_dates(spark, sf_dir):
    return rounded(S.fill_missing_dates(fixture(spark, sf_dir, "fx_daily"), BY, "d").select("series", "d", "open"), 6)


@register("f01_fill_missing_dates_impute", with_fixture("fx_daily", FILLED + """
SELECT c.series, c.d, round(CASE WHEN x.d IS NULL THEN 0.0 ELSE x.open END, 6) AS open
FROM cal c LEFT JOIN fx_daily x ON c.series = x.series AND c.d = x.d"""))
def q_fill_dates_impute(spark, sf_dir):
    return rounded(S.fill_missing_dates(fixture(spark, sf_dir, "fx_daily"), BY, "d", impute={"open": 0.0})
                   .select("series", "d", "open"), 6)


@register("f02_backfill", with_fixture("fx_daily", FILLED + """
SELECT series, d, round(open, 6) AS open, high, low FROM bf"""))
def q_backfill(spark, sf_dir):
    return rounded(filled_daily(spark, sf_dir).select("series", "d", "open", "high", "low"), 6)


@register("f03_diff", with_fixture("fx_daily", FILLED + """
SELECT * FROM (SELECT series, d, round(open - lag(open) OVER (PARTITION BY series ORDER BY d), 6) AS open FROM bf)
WHERE open IS NOT NULL"""))
def q_diff(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    return rounded(S.diff(f, BY, "_pos", ["open"]).select("series", "d", "open"), 6)


@register("f04_add_lags", with_fixture("fx_daily", """
SELECT series, d, round(open, 6) AS open, round(lag(open, 1) OVER w, 6) AS open_lag_value_1,
       round(lag(open, 2) OVER w, 6) AS open_lag_value_2, round(lag(open, 7) OVER w, 6) AS open_lag_value_7
FROM fx_daily WINDOW w AS (PARTITION BY series ORDER BY d)"""))
def q_lags(spark, sf_dir):
    daily = S.positions(fixture(spark, sf_dir, "fx_daily"), BY, "d")
    out = S.add_lags(daily, BY, "_pos", "open", [1, 2, 7])
    return rounded(out.select("series", "d", "open", "open_lag_value_1", "open_lag_value_2", "open_lag_value_7"), 6)


def _roll_sql(w: int) -> str:
    win = f"(PARTITION BY series ORDER BY d ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    g = f"CASE WHEN count(open) OVER {win} = {w} THEN"
    return f"""
SELECT series, d, {g} round(avg(open) OVER {win}, 6) END AS recent_mean_{w},
  {g} round(stddev_samp(open) OVER {win}, 4) END AS recent_std_dev_{w},
  {g} round(min(open) OVER {win}, 6) END AS recent_min_{w}, {g} round(max(open) OVER {win}, 6) END AS recent_max_{w}
FROM bf"""


@register("f05_rolling_stats", with_fixture("fx_daily", FILLED + _roll_sql(7)))
def q_rolling(spark, sf_dir):
    out = S.rolling_stats(filled_daily(spark, sf_dir), BY, "_pos", "open", 7)
    return rounded(out.select("series", "d", "recent_mean_7", "recent_std_dev_7", "recent_min_7", "recent_max_7"),
                   {"recent_mean_7": 6, "recent_std_dev_7": 4, "recent_min_7": 6, "recent_max_7": 6})


@register("f06_f07_growth_features", with_fixture("fx_daily", FILLED + """
, g AS (SELECT series, d, open / lag(open, 7) OVER w - 1 AS g7, open / lag(open, 1) OVER w - 1 AS g1
        FROM bf WINDOW w AS (PARTITION BY series ORDER BY d))
SELECT series, d, round(g7, 9) AS "1_week_pct_growth",
  round(CASE WHEN count(g1) OVER v = 30 THEN stddev_samp(g1) OVER v END, 9) AS growth_volatility_past_month
FROM g WINDOW v AS (PARTITION BY series ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def q_growth(spark, sf_dir):
    out = S.growth_features(filled_daily(spark, sf_dir), BY, "_pos", "open")
    return rounded(out.select("series", "d", "1_week_pct_growth", "growth_volatility_past_month"), 9)


@register("f08_fourier_terms", with_fixture("fx_daily", """
SELECT series, d, """ + ", ".join(
    f"round(sin(2 * pi() * {i} * pos / 7), 9) + 0.0 AS fourier_s7_{i}, "
    f"round(cos(2 * pi() * {i} * pos / 7), 9) + 0.0 AS fourier_c7_{i}"
    for i in (1, 2, 3)) + """
FROM (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d) AS pos FROM fx_daily)"""))
def q_fourier(spark, sf_dir):
    daily = S.positions(fixture(spark, sf_dir, "fx_daily"), BY, "d")
    out = S.fourier_terms(daily, "_pos", 7, 3)
    return rounded(out.select("series", "d", *[f"fourier_{t}7_{i}" for i in (1, 2, 3) for t in "sc"]), 9)


ACF_SQL = FILLED + """
, dd AS (SELECT series, d, open - lag(open) OVER (PARTITION BY series ORDER BY d) AS x FROM bf),
st AS (SELECT * FROM dd WHERE x IS NOT NULL),
z AS (SELECT s.series, s.d, s.x - m.mu AS z FROM st s JOIN (SELECT series, avg(x) AS mu FROM st GROUP BY series) m
      ON s.series = m.series),
zl AS (SELECT series, z, {lags} FROM z WINDOW w AS (PARTITION BY series ORDER BY d)),
ac AS (SELECT series, {sums}, sum(z * z) AS s0 FROM zl GROUP BY series)"""


def _acf_sql(k: int) -> str:
    return ACF_SQL.format(lags=", ".join(f"lag(z, {i}) OVER w AS z{i}" for i in range(1, k + 1)),
                          sums=", ".join(f"sum(z * z{i}) AS s{i}" for i in range(1, k + 1)))


def diffed(spark, sf_dir):
    return S.diff(filled_daily(spark, sf_dir), BY, "_pos", ["open"])


@register("f11_acf", with_fixture("fx_daily", _acf_sql(10) + " " + " UNION ALL ".join(
    ["SELECT series, CAST(0 AS INTEGER) AS lag, 1.0 AS acf FROM ac"]
    + [f"SELECT series, CAST({i} AS INTEGER) AS lag, round(s{i} / s0, 9) AS acf FROM ac" for i in range(1, 11)])))
def q_acf(spark, sf_dir):
    return rounded(S.acf(diffed(spark, sf_dir), BY, "_pos", "open", 10), 9)


@register("f12_pacf", with_fixture("fx_daily", _acf_sql(3) + """
, r AS (SELECT series, s1 / s0 AS r1, s2 / s0 AS r2, s3 / s0 AS r3 FROM ac),
p2 AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p22 FROM r),
p3 AS (SELECT *, r1 - p22 * r1 AS p21 FROM p2)
SELECT series, CAST(0 AS INTEGER) AS lag, 1.0 AS pacf FROM p3
UNION ALL SELECT series, 1, round(r1, 9) FROM p3
UNION ALL SELECT series, 2, round(p22, 9) FROM p3
UNION ALL SELECT series, 3, round((r3 - p21 * r2 - p22 * r1) / (1 - p21 * r1 - p22 * r2), 9) FROM p3"""))
def q_pacf(spark, sf_dir):
    return rounded(S.pacf(diffed(spark, sf_dir), BY, "_pos", "open", 3), 9)


@register("f14_future_frame", with_fixture("fx_daily", FILLED + """
, n AS (SELECT series, max(pos) AS len, max(d) AS dl FROM bf GROUP BY series),
fut AS (SELECT n.series, n.len + k AS pos, CAST(n.dl + CAST(k AS INTEGER) AS DATE) AS d, CAST(NULL AS DOUBLE) AS open
        FROM n, range(1, 31) t(k)),
frame AS (SELECT series, pos, d, open FROM bf UNION ALL SELECT * FROM fut)
SELECT f.series, f.d, round(f.open, 6) AS open, e.high, e.low FROM frame f
LEFT JOIN bf e ON e.series = f.series AND e.pos + 30 = f.pos WHERE f.pos > 30"""))
def q_future(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    out = S.future_frame(f, BY, "d", "_pos", 30, ["high", "low"], ["open"])
    return rounded(out.select("series", "d", "open", "high", "low"), {"open": 6})


@register("f15_last_n_holdout", with_fixture("fx_daily", FILLED + """
SELECT series, d, CASE WHEN pos > max(pos) OVER (PARTITION BY series) - 30 THEN 'test' ELSE 'train' END AS role FROM bf"""))
def q_holdout(spark, sf_dir):
    return S.last_n_holdout(filled_daily(spark, sf_dir), BY, "_pos", 30).select("series", "d", "role")


@register("f18_information_criteria", with_fixture("fx_daily", """
, c AS (SELECT series, regr_slope(open, high) AS b, regr_intercept(open, high) AS a FROM fx_daily GROUP BY series),
e AS (SELECT x.series, sum(pow(x.open - c.a - c.b * x.high, 2)) AS sse, count(*) AS n FROM fx_daily x
      JOIN c ON x.series = c.series GROUP BY x.series),
l AS (SELECT series, sse, n, -n / 2.0 * (ln(2 * pi() * sse / n) + 1) AS ll FROM e)
SELECT series, CAST(n AS BIGINT) AS n, round(ll, 4) AS ll, round(2 * 2 - 2 * ll, 4) AS aic,
       round(2 * ln(n) - 2 * ll, 4) AS bic FROM l"""))
def q_ic(spark, sf_dir):
    daily = fixture(spark, sf_dir, "fx_daily")
    c = daily.groupBy("series").agg(F.regr_slope("open", "high").alias("b"),
                                    F.regr_intercept("open", "high").alias("a"))
    e = daily.join(c, "series").groupBy("series").agg(
        F.sum(F.pow(F.col("open") - F.col("a") - F.col("b") * F.col("high"), 2)).alias("sse"),
        F.count(F.lit(1)).alias("n"))
    ll, aic, bic = S.information_criteria(F.col("sse"), F.col("n"), F.lit(2))
    return rounded(e.select("series", "n", ll.alias("ll"), aic.alias("aic"), bic.alias("bic")), 4)


@register("f19_ljung_box", with_fixture("fx_daily", _acf_sql(5) + """
, n AS (SELECT series, count(*) AS n FROM st GROUP BY series),
t AS (""" + " UNION ALL ".join(
    f"SELECT a.series, {k} AS lag, n.n * (n.n + 2) * pow(a.s{k} / a.s0, 2) / (n.n - {k}) AS term "
    f"FROM ac a JOIN n ON a.series = n.series" for k in range(1, 6)) + """)
SELECT series, CAST(lag AS INTEGER) AS lag,
       round(sum(term) OVER (PARTITION BY series ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
       AS lb_stat FROM t"""))
def q_ljung(spark, sf_dir):
    out = S.ljung_box(diffed(spark, sf_dir), BY, "_pos", "open", 5)
    return rounded(out.select("series", "lag", "lb_stat"), 6)


@register("f19_ljung_box_pvalue")
def q_ljung_p(spark, sf_dir):
    return S.ljung_box(diffed(spark, sf_dir), BY, "_pos", "open", 5)


@register("f20_time_series_folds", with_fixture("fx_daily", """
, p AS (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d) AS pos,
               count(*) OVER (PARTITION BY series) AS len FROM fx_daily),
f AS (SELECT p.*, CAST(fold AS INTEGER) AS fold, len - (5 - fold) * 30 + 1 AS st FROM p, range(0, 5) t(fold))
SELECT series, d, fold, CASE WHEN pos < st THEN 'train' ELSE 'test' END AS role FROM f
WHERE st > 1 AND pos < st + 30"""))
def q_folds(spark, sf_dir):
    daily = S.positions(fixture(spark, sf_dir, "fx_daily"), BY, "d")
    return S.time_series_folds(daily, BY, "_pos", 5, 30).select("series", "d", "fold", "role")


@register("f21_seasonality_yearly", with_fixture("fx_daily", """
SELECT CAST(year(d) AS INTEGER) AS across, CAST(month(d) AS INTEGER) AS down, round(avg(open), 6) AS mean
FROM fx_daily GROUP BY 1, 2"""))
def q_season(spark, sf_dir):
    return rounded(S.seasonality(fixture(spark, sf_dir, "fx_daily"), "d", "open", "yearly"), 6)


@register("f21_seasonality_weekly", with_fixture("fx_daily", """
SELECT CAST(weekofyear(d) AS INTEGER) AS across, CAST(isodow(d) - 1 AS INTEGER) AS down,
       round(avg(spread), 9) AS mean
FROM fx_daily GROUP BY 1, 2"""))
def q_season_w(spark, sf_dir):
    return rounded(S.seasonality(fixture(spark, sf_dir, "fx_daily"), "d", "spread", "weekly"), 9)


@register("f21_seasonality_monthly", with_fixture("fx_daily", """
SELECT CAST(month(d) AS INTEGER) AS across, CAST(day(d) AS INTEGER) AS down, round(avg(open), 6) AS mean
FROM fx_daily GROUP BY 1, 2"""))
def q_season_m(spark, sf_dir):
    return rounded(S.seasonality(fixture(spark, sf_dir, "fx_daily"), "d", "open", "monthly"), 6)


@register("f05_f07_rolling_feature_series", with_fixture("fx_daily", FILLED + """
, g AS (SELECT series, d, open, open / lag(open, 7) OVER w - 1 AS g7, open / lag(open, 1) OVER w - 1 AS g1,
               count(open) OVER r AS n, avg(open) OVER r AS av, stddev_samp(open) OVER r AS sd, min(open) OVER r AS mi, max(open) OVER r AS ma
        FROM bf WINDOW w AS (PARTITION BY series ORDER BY d),
                       r AS (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT series, d, round(open, 6) AS open, round(CASE WHEN n = 7 THEN av END, 6) AS recent_mean_7, round(CASE WHEN n = 7 THEN sd END, 4) AS recent_std_dev_7,
  round(CASE WHEN n = 7 THEN mi END, 6) AS recent_min_7, round(CASE WHEN n = 7 THEN ma END, 6) AS recent_max_7, round(g7, 9) AS "1_week_pct_growth",
  round(CASE WHEN count(g1) OVER v = 30 THEN stddev_samp(g1) OVER v END, 9) AS growth_volatility_past_month
FROM g WINDOW v AS (PARTITION BY series ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def q_rolling_features(spark, sf_dir):
    """The whole feature builder: gap fill, back fill, rolling 7, growth."""
    out = S.additional_regressors(filled_daily(spark, sf_dir), BY, "_pos", "open", 7)
    out = out.select("series", "d", "open", "recent_mean_7", "recent_std_dev_7", "recent_min_7",
                     "recent_max_7", "1_week_pct_growth", "growth_volatility_past_month")
    return rounded(out, {"open": 6, "recent_mean_7": 6, "recent_std_dev_7": 4, "recent_min_7": 6, "recent_max_7": 6,
                         "1_week_pct_growth": 9, "growth_volatility_past_month": 9})
