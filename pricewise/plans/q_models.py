"""Checked queries for regression, diagnostics and time-series models (G,
F9/F10/F13/F16/F17/F22, E2/E8, A9)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pricewise.functions.linalg import ols_by_group
from pricewise.operators import arima as A
from pricewise.operators import cells as C
from pricewise.operators import diagnostics as D
from pricewise.operators import features as E
from pricewise.operators import forest as I
from pricewise.operators import nets as N
from pricewise.operators import regress as M
from pricewise.operators import series as S
from pricewise.operators import trees as R
from pricewise.operators import tsmodels as T
from pricewise.operators.anomaly import isolation_anomalies
from pricewise.operators.features import split_hash
from pricewise.plans.q_features import ONE_HOT_LEVELS
from pricewise.plans.q_series import BY, FILLED, filled_daily
from pricewise.plans.registry import register, rounded
from pricewise.session import checkpoint_dir, shared_folder, with_scalars, written
from pricewise.sources.fixtures import fixture, with_fixture

EPS = "2.220446049250313e-16"


# ------------------------------------------------------------- G1, G7, G8
@register("g01_eval_metrics", with_fixture("fx_residuals", f"""
SELECT round(avg(abs(actual - predicted)), 9) AS MAE,
       round(avg(abs(actual - predicted) / greatest(abs(actual), {EPS})), 9) AS MAPE,
       round(avg(pow(actual - predicted, 2)), 6) AS MSE,
       round(sqrt(avg(pow(actual - predicted, 2))), 9) AS RMSE,
       round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(actual)), 9) AS r2
FROM fx_residuals"""))
def q_eval(spark, sf_dir):
    out = D.eval_metrics(fixture(spark, sf_dir, "fx_residuals"), "actual", "predicted")
    return rounded(out, {"MAE": 9, "MAPE": 9, "MSE": 6, "RMSE": 9, "r2": 9})


@register("g07_compare_models", with_fixture("fx_residuals", """
, s AS (SELECT 'group_mean' AS model, actual, predicted FROM fx_residuals
        UNION ALL SELECT 'global_mean', actual, (SELECT avg(actual) FROM fx_residuals) FROM fx_residuals)
SELECT model, round(avg(abs(actual - predicted)), 9) AS MAE,
       round(avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)), 9) AS MAPE,
       round(avg(pow(actual - predicted, 2)), 6) AS MSE, round(sqrt(avg(pow(actual - predicted, 2))), 9) AS RMSE,
       round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(actual)), 9) AS r2
FROM s GROUP BY model"""))
def q_compare(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_residuals")
    glob = with_scalars(fx, fx.agg(F.avg("actual").alias("_m"))) \
        .withColumn("predicted", F.col("_m")).drop("_m")  # one-row mean
    out = D.compare_models({"group_mean": fx, "global_mean": glob}, "actual", "predicted")
    return rounded(out, {"MAE": 9, "MAPE": 9, "MSE": 6, "RMSE": 9, "r2": 9})


@register("g08_residuals", with_fixture("fx_residuals", """
SELECT i, round(abs(actual) - abs(predicted), 9) AS residual FROM fx_residuals"""))
def q_resid(spark, sf_dir):
    out = D.residuals(fixture(spark, sf_dir, "fx_residuals"), "actual", "predicted")
    return rounded(out.select("i", "residual"), 9)


@register("g09_linearity_data", with_fixture("fx_residuals", """
, r AS (SELECT min(actual) AS x0, max(actual) AS x1, min(predicted) AS y0, max(predicted) AS y1 FROM fx_residuals)
SELECT CAST(CASE WHEN (x1 - x0) / 20 = 0 THEN 0 ELSE least(floor((actual - x0) / ((x1 - x0) / 20)), 19) END AS INTEGER) AS bx,
       CAST(CASE WHEN (y1 - y0) / 20 = 0 THEN 0 ELSE least(floor((predicted - y0) / ((y1 - y0) / 20)), 19) END AS INTEGER) AS "by",
       CAST(count(*) AS BIGINT) AS count
FROM fx_residuals, r GROUP BY 1, 2"""))
def q_linearity(spark, sf_dir):
    pts, _ = D.linearity_data(fixture(spark, sf_dir, "fx_residuals"), "actual", "predicted", 20)
    return pts


# ------------------------------------------------------------- G2 OLS (k = 1 closed form)
@register("g02_fit_ols", with_fixture("fx_listings", """
SELECT 'intercept' AS term, round(regr_intercept(price, power), 6) AS coef FROM fx_listings
UNION ALL SELECT 'power', round(regr_slope(price, power), 6) FROM fx_listings
UNION ALL SELECT '_r2', round(regr_r2(price, power), 9) FROM fx_listings"""))
def q_ols(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    out = ols_by_group(fx, [], ["power"], "price").where(F.col("term").isin("intercept", "power", "_r2"))
    coef = F.when(F.col("term") == "_r2", F.round(F.col("coef") * 1e9, 0) / 1e9) \
        .otherwise(F.round(F.col("coef") * 1e6, 0) / 1e6) + F.lit(0.0)
    return out.select("term", coef.alias("coef"))


# ------------------------------------------------------------- G10-G13
@register("g10_normality_ad")
def q_ad(spark, sf_dir):
    fx = D.residuals(fixture(spark, sf_dir, "fx_residuals"), "actual", "predicted", signed=True)
    return D.normality_ad(fx, "residual")


@register("g11_vif", with_fixture("fx_listings", """
, s AS (SELECT sum(kilometers * kilometers) AS xx, sum(power * power) AS yy, sum(kilometers * power) AS xy
        FROM fx_listings WHERE kilometers IS NOT NULL AND power IS NOT NULL)
SELECT 'kilometers' AS feature, round(1 / (1 - xy * xy / (xx * yy)), 6) AS vif FROM s
UNION ALL SELECT 'power', round(1 / (1 - xy * xy / (xx * yy)), 6) FROM s"""))
def q_vif(spark, sf_dir):
    return rounded(D.vif(fixture(spark, sf_dir, "fx_listings"), ["kilometers", "power"]), 6)


@register("g11_vif_summary")
def q_vif_summary(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return D.vif_summary(D.vif(fx, ["kilometers", "power", "cylinder", "age"]))


@register("g12_durbin_watson", with_fixture("fx_residuals", """
, r AS (SELECT i, actual - predicted AS e FROM fx_residuals),
l AS (SELECT e, e - lag(e) OVER (ORDER BY i) AS de FROM r)
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(de * de) / sum(e * e), 9) AS durbin_watson,
       CASE WHEN sum(de * de) / sum(e * e) < 1.5 THEN 'positive autocorrelation'
            WHEN sum(de * de) / sum(e * e) > 2.5 THEN 'negative autocorrelation'
            ELSE 'little to no autocorrelation' END AS verdict FROM l"""))
def q_dw(spark, sf_dir):
    fx = D.residuals(fixture(spark, sf_dir, "fx_residuals"), "actual", "predicted", signed=True)
    return rounded(D.durbin_watson(fx, "residual", "i"), 9)


@register("g13_residual_spread", with_fixture("fx_residuals", """
, r AS (SELECT actual - predicted AS e, row_number() OVER (ORDER BY i) AS rk, count(*) OVER () AS n FROM fx_residuals)
SELECT CAST(floor((rk - 1) * 10 / n) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n,
       round(avg(e), 9) AS mean, round(stddev_samp(e), 9) AS std FROM r GROUP BY 1"""))
def q_spread(spark, sf_dir):
    fx = D.residuals(fixture(spark, sf_dir, "fx_residuals"), "actual", "predicted", signed=True)
    return rounded(D.residual_spread(fx, "residual", "i", 10), 9)


# ------------------------------------------------------------- G3-G6, E2, E8, A9
_X = ["age", "year", "price"]


def _ml_frame(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return fx.where(F.col("power").isNotNull())


#: The fold of a row in SQL.
FOLD_SQL = "CAST((CAST(('0x' || substr(md5('42' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000) % 5 AS INTEGER)"


@register("g06_cv_fold_sizes", with_fixture("fx_listings", f"""
SELECT {FOLD_SQL} AS fold, CAST(count(*) AS BIGINT) AS n FROM fx_listings WHERE power IS NOT NULL GROUP BY 1"""))
def q_folds(spark, sf_dir):
    return M.with_fold(_ml_frame(spark, sf_dir), "id", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def _scores(spark, cv, grid, names):
    rows = [(str({n: s[0].get(n) for n in names}), s[1]) for s in M.cv_scores(cv, grid)]
    return spark.createDataFrame(rows, "setting string, rmse double")


@register("g03_lasso_cv")
def q_lasso(spark, sf_dir):
    """5-fold lasso over 10 alphas from one grouped moment aggregation."""
    path, best = M.lasso_path_cv(_ml_frame(spark, sf_dir), "power", _X, "id")
    rows = [(r["alpha"], r["rmse"], r["l1_norm"], r["nonzero"], r["alpha"] == best["alpha"]) for r in path]
    return spark.createDataFrame(rows, "alpha double, rmse double, l1_norm double, nonzero int, best boolean")


@register("g03_lasso_cv_ml")
def q_lasso_ml(spark, sf_dir):
    """The same search with pyspark.ml LinearRegression fits per fold."""
    cv, grid = M.fit_lasso_cv(_ml_frame(spark, sf_dir), "power", _X, "id")
    return _scores(spark, cv, grid, ["regParam"])


def _settings():
    return M.sample_settings(R.BOOSTED_SPACE, R.SETTINGS)


def _boosted_features(fx):
    return C.numeric_features(fx, _X, bins=32)


@register("g04_boosted_search")
def q_boosted(spark, sf_dir):
    """50 settings x 5 folds x 1,000 rounds: mean held-out RMSE per setting."""
    fx, settings = _ml_frame(spark, sf_dir), _settings()
    scores = R.boosted_scores(fx, "power", _boosted_features(fx), "id", settings)
    names = list(R.BOOSTED_SPACE)
    table = spark.createDataFrame([(i, *[float(s[n]) for n in names]) for i, s in enumerate(settings)],
                                  "setting int, " + ", ".join(f"{n} double" for n in names))
    mean = scores.groupBy("setting").agg(F.count("rmse").alias("folds"), F.avg("rmse").alias("rmse"), F.stddev("rmse").alias("spread"))
    return table.join(mean, "setting")


#: One stump: a tree of depth 1 after one round, whose splits SQL can compute.
_STUMP = {"max_depth": 1, "gamma": 0.0, "eta": 0.3, "subsample": 1.0, "min_child_weight": 0.0, "reg_lambda": 2.0}
_STUMP_BINS = 8
_STUMP_CODES = f"""
, t AS (SELECT id, CAST(age AS DOUBLE) AS age, price, power, {FOLD_SQL} AS fold FROM fx_listings WHERE power IS NOT NULL),
edges AS (SELECT DISTINCT unnest(quantile_cont(price, [{", ".join(str(i / _STUMP_BINS) for i in range(1, _STUMP_BINS))}])) AS e FROM t),
coded AS (SELECT id, fold, power, 'price' AS feature, (SELECT 1 + count(*) FROM edges WHERE t.price > e) AS bin FROM t
          UNION ALL SELECT id, fold, power, 'age', dense_rank() OVER (ORDER BY age) FROM t)"""


def _stump_features(fx):
    return C.numeric_features(fx, ["price", "age"], bins=_STUMP_BINS)


@register("g04_split_gains", with_fixture("fx_listings", _STUMP_CODES + """,
sums AS (SELECT feature, bin, sum((SELECT avg(power) FROM t) - power) AS g, count(*) AS h FROM coded GROUP BY feature, bin),
run AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER v AS g, sum(h) OVER v AS h FROM sums
        WINDOW w AS (PARTITION BY feature ORDER BY bin), v AS (PARTITION BY feature))
SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(hl AS DOUBLE) AS n_left,
       round(gl * gl / (hl + 2) + (g - gl) * (g - gl) / (h - hl + 2) - g * g / (h + 2), 4) AS gain
FROM run WHERE h > hl"""))
def q_split_gains(spark, sf_dir):
    """Gain of every split of the first tree's root, by the level aggregate."""
    fx = _ml_frame(spark, sf_dir)
    features = _stump_features(fx)
    table, _ = C.cell_table(fx, features, ["power"], "id")
    gains = R.split_gains(R.root_sums(table, features), [], F.lit(_STUMP["reg_lambda"]), F.lit(0.0))
    return rounded(gains.select("feature", "bin", F.col("hl").alias("n_left"), "gain"), 4)


@register("g04_boosted_stump", with_fixture("fx_listings", _STUMP_CODES + """,
f AS (SELECT DISTINCT fold AS held FROM t),
mean AS (SELECT held, avg(power) AS m FROM t JOIN f ON fold <> held GROUP BY held),
sums AS (SELECT held, feature, bin, sum(m - power) AS g, count(*) AS h FROM coded JOIN mean ON fold <> held GROUP BY held, feature, bin),
run AS (SELECT held, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER v AS g, sum(h) OVER v AS h FROM sums
        WINDOW w AS (PARTITION BY held, feature ORDER BY bin), v AS (PARTITION BY held, feature)),
best AS (SELECT held, feature, bin, -gl / (hl + 2) AS lv, -(g - gl) / (h - hl + 2) AS rv FROM run WHERE h > hl
         QUALIFY row_number() OVER (PARTITION BY held ORDER BY gl * gl / (hl + 2) + (g - gl) * (g - gl) / (h - hl + 2) DESC, feature DESC, bin) = 1)
SELECT CAST(b.held AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n,
       round(sqrt(avg(pow(c.power - m.m - 0.3 * CASE WHEN c.bin <= b.bin THEN lv ELSE rv END, 2))), 6) AS rmse
FROM coded c JOIN best b ON c.fold = b.held AND c.feature = b.feature JOIN mean m ON m.held = b.held GROUP BY b.held"""))
def q_stump(spark, sf_dir):
    """Held-out RMSE per fold after one round of one split."""
    fx = _ml_frame(spark, sf_dir)
    scores = R.boosted_scores(fx, "power", _stump_features(fx), "id", [_STUMP], rounds=1)
    sizes = M.with_fold(fx, "id", R.FOLDS).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return rounded(scores.join(sizes, "fold").select("fold", "n", "rmse"), 6)


@register("g05_net_search")
def q_nets(spark, sf_dir):
    """50 settings x 5 folds by successive halving: mean held-out RMSE of each
    setting on every rung that it reached."""
    settings = M.sample_settings(N.NET_SPACE, N.SETTINGS)
    folder = os.path.join(shared_folder(spark), f"net-search-{uuid.uuid4().hex}")
    found = N.search_nets(_ml_frame(spark, sf_dir), "power", _X, "id", settings, folder)
    names = list(N.NET_SPACE)
    table = spark.createDataFrame([(i, *[float(s[n]) for n in names], i == found.best) for i, s in enumerate(settings)],
                                  "setting int, " + ", ".join(f"{n} double" for n in names) + ", best boolean")
    mean = found.scores.groupBy("setting", "rung", "steps").agg(F.count("rmse").alias("folds"), F.avg("rmse").alias("rmse"))
    return table.join(mean, "setting")


@register("g05_training_scales", with_fixture("fx_listings", f"""
, t AS (SELECT {FOLD_SQL} AS fold, price, power FROM fx_listings WHERE power IS NOT NULL AND price IS NOT NULL), v AS (SELECT unnest(range(0, 6)) AS held)
SELECT CAST(held AS INTEGER) AS held, CAST(count(*) AS BIGINT) AS n, round(min(price), 4) AS low, round(max(price) - min(price), 4) AS width,
       round(avg(power), 6) AS mean, round(stddev_pop(power), 5) AS spread FROM t JOIN v ON fold <> held GROUP BY held"""))
def q_net_scales(spark, sf_dir):
    """Input range and target scale of every fold's training rows (5: all)."""
    fx = M.with_fold(_ml_frame(spark, sf_dir), "id", N.FOLDS).select("fold", F.col("price").alias("x0"), F.col("power").cast("double").alias("y"))
    rows = [(v, s.rows, float(s.low[0]), float(s.width[0]), s.mean, s.spread) for v, s in enumerate(N.fold_scales(fx, 1, N.FOLDS))]
    return rounded(spark.createDataFrame(rows, "held int, n long, low double, width double, mean double, spread double"),
                   {"low": 4, "width": 4, "mean": 6, "spread": 5})


@register("g07_fitted_models")
def q_fitted(spark, sf_dir):
    """Least squares, lasso and boosted trees on the same hold-out rows."""
    return D.compare_models(M.fitted_models(_ml_frame(spark, sf_dir), "power", _X, "id"), "power", "prediction")


_OLS_SQL = """
, p AS (SELECT id, CAST(price AS DOUBLE) AS x, CAST(power AS DOUBLE) AS y,
               CAST(('0x' || substr(md5('42' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296 < 0.8 AS train
        FROM fx_listings WHERE power IS NOT NULL AND price IS NOT NULL),
b AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM p WHERE train),
e AS (SELECT id, train, y, b0 + b1 * x AS f, y - b0 - b1 * x AS e FROM p, b)"""


@register("g07_fitted_ols", with_fixture("fx_listings", _OLS_SQL + f"""
SELECT 'ols' AS model, round(avg(abs(e)), 6) AS MAE, round(avg(abs(e) / greatest(abs(y), {EPS})), 6) AS MAPE, round(avg(e * e), 4) AS MSE,
       round(sqrt(avg(e * e)), 6) AS RMSE, round(1 - sum(e * e) / (var_pop(y) * count(y)), 9) AS r2 FROM e WHERE NOT train"""))
def q_fitted_ols(spark, sf_dir):
    parts = E.train_test_split(_ml_frame(spark, sf_dir), "id", 0.8)
    model = M.fit_ols(parts.where("role = 'train'"), "power", ["price"])
    scored = M.predict_ols(parts.where("role = 'test'"), model)
    return rounded(D.compare_models({"ols": scored}, "power", "prediction"), {"MAE": 6, "MAPE": 6, "MSE": 4, "RMSE": 6, "r2": 9})


def _ols_residuals(spark, sf_dir):
    """Residuals of least squares on its training rows."""
    train = E.train_test_split(_ml_frame(spark, sf_dir), "id", 0.8).where("role = 'train'")
    return D.residuals(M.predict_ols(train, M.fit_ols(train, "power", ["price"])), "power", "prediction", signed=True)


@register("g12_ols_durbin_watson", with_fixture("fx_listings", _OLS_SQL + """
, l AS (SELECT e, e - lag(e) OVER (ORDER BY id) AS de FROM e WHERE train)
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(de * de) / sum(e * e), 9) AS durbin_watson,
       CASE WHEN sum(de * de) / sum(e * e) < 1.5 THEN 'positive autocorrelation'
            WHEN sum(de * de) / sum(e * e) > 2.5 THEN 'negative autocorrelation' ELSE 'little to no autocorrelation' END AS verdict FROM l"""))
def q_ols_dw(spark, sf_dir):
    return rounded(D.durbin_watson(_ols_residuals(spark, sf_dir), "residual", "id"), 9)


@register("g13_ols_residual_spread", with_fixture("fx_listings", _OLS_SQL + """
, r AS (SELECT e, row_number() OVER (ORDER BY id) AS rk, count(*) OVER () AS n FROM e WHERE train)
SELECT CAST(floor((rk - 1) * 10 / n) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS std
FROM r GROUP BY 1"""))
def q_ols_spread(spark, sf_dir):
    return rounded(D.residual_spread(_ols_residuals(spark, sf_dir), "residual", "id", 10), 6)


@register("g10_ols_normality_ad")
def q_ols_ad(spark, sf_dir):
    return D.normality_ad(_ols_residuals(spark, sf_dir), "residual")


@register("g03_lasso_one_input", with_fixture("fx_listings", f"""
, t AS (SELECT {FOLD_SQL} AS fold, CAST(price AS DOUBLE) / 1000 AS x, CAST(power AS DOUBLE) AS y FROM fx_listings WHERE power IS NOT NULL),
a AS (SELECT 0.03 + i * (5 - 0.03) / 9 AS alpha FROM range(0, 10) r(i)), f AS (SELECT DISTINCT fold AS held FROM t),
m AS (SELECT held, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c, var_pop(x) AS s FROM t JOIN f ON fold <> held GROUP BY held),
b AS (SELECT held, alpha, mx, my, sign(c) * greatest(abs(c) - alpha, 0) / s AS b FROM m, a),
e AS (SELECT alpha, held, sqrt(avg(pow(y - my - b * (x - mx), 2))) AS rmse FROM t JOIN b ON fold = held GROUP BY alpha, held)
SELECT round(alpha, 6) AS alpha, round(avg(rmse), 6) AS rmse FROM e GROUP BY alpha"""))
def q_lasso_one(spark, sf_dir):
    """One input: the lasso is a soft threshold of its covariance."""
    fx = _ml_frame(spark, sf_dir).withColumn("x", F.col("price") / 1000)
    path, _ = M.lasso_path_cv(fx, "power", ["x"], "id")
    return rounded(spark.createDataFrame([(r["alpha"], r["rmse"]) for r in path], "alpha double, rmse double"), 6)


#: Declared category levels, as one-hot columns.
_LEVELS = ONE_HOT_LEVELS | {"wheel_drive": ["F", "O", "P"]}
_HOLED = ["kilometers", "trunk", "cylinder", "power"]  # the columns with missing values


def _imputed(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "age", *_LEVELS, *_HOLED)
    return I.impute_by_forest(fx, _HOLED, C.category_features(_LEVELS) + C.numeric_features(fx, ["age"]), "id")


@register("e02_impute_by_forest", with_fixture("fx_listings", "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS filled, CAST(0 AS BIGINT) AS nulls_left,
       round(sum(CAST({c} AS DOUBLE)), 3) AS known_sum, true AS in_range FROM fx_listings""" for c in _HOLED) + ")"))
def q_impute_forest(spark, sf_dir):
    """Every NULL of four columns filled (72 settings x 5 folds): what must hold
    of the filled table, also beside the values that were known."""
    fx = fixture(spark, sf_dir, "fx_listings").select("id", *[F.col(c).cast("double").alias(f"_{c}") for c in _HOLED])
    both = _imputed(spark, sf_dir)[0].select("id", *_HOLED).join(fx, "id")
    bounds = both.agg(*[f(f"_{c}").alias(f"{k}{c}") for c in _HOLED for f, k in ((F.min, "lo_"), (F.max, "hi_"))])
    filled = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), F.col(f"_{c}").alias("known"),
                       F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in _HOLED]
    rows = with_scalars(both, bounds).select(F.inline(F.array(*filled)))
    inside = F.col("v").between(F.col("lo") - 1e-6, F.col("hi") + 1e-6)
    out = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("filled"), F.count_if(F.col("v").isNull()).alias("nulls_left"),
        F.sum(F.when(F.col("known").isNotNull(), F.col("v"))).alias("known_sum"), F.bool_and(inside).alias("in_range"))
    return rounded(out, 3)


@register("e02_forest_scores")
def q_forest_scores(spark, sf_dir):
    """Mean held-out r2 of the 72 settings for every imputed column."""
    return _imputed(spark, sf_dir)[1]


@register("e08_forest_importance")
def q_importance(spark, sf_dir):
    # bins, means and cells read the rows several times: the joined table is written once
    fx, _ = written(fixture(spark, sf_dir, "fx_listings").select("id", "price", "age", *_LEVELS, *_HOLED[:3]))
    return I.forest_importance(fx, "price", C.category_features(_LEVELS) + C.numeric_features(fx, ["age", *_HOLED[:3]]), "id")


@register("e08_importance_totals", "SELECT * FROM (VALUES (CAST(14 AS BIGINT), 1.0::DOUBLE, true)) t(features, total, not_negative)")
def q_importance_totals(spark, sf_dir):
    """Importances of all one-hot and numeric inputs sum to 1."""
    out = q_importance(spark, sf_dir).agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"),
                                          F.bool_and(F.col("importance") >= 0).alias("not_negative"))
    return rounded(out, 9)


@register("a09_pipeline_predictions", with_fixture("fx_listings", """
, p AS (SELECT id, CAST(age AS DOUBLE) AS x, CAST(power AS DOUBLE) AS y FROM fx_listings WHERE power IS NOT NULL)
SELECT id, round(regr_intercept(y, x) OVER () + regr_slope(y, x) OVER () * x, 4) AS prediction FROM p"""))
def q_pipeline_predictions(spark, sf_dir):
    """A saved and loaded pipeline predicts what least squares gives."""
    fx = _ml_frame(spark, sf_dir)
    path = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    M.save_pipeline(M.fit_scoring_pipeline(fx, ["age"], "power"), path)
    return rounded(M.load_pipeline(path).transform(fx).select("id", "prediction"), 4)


@register("a09_save_load_pipeline")
def q_save_load(spark, sf_dir):
    fx = _ml_frame(spark, sf_dir)
    train = fx.where(split_hash("id") < 800)
    model = M.fit_scoring_pipeline(train, ["age", "kilometers", "price"], "power")
    path = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    M.save_pipeline(model, path)
    again = M.load_pipeline(path)
    a = model.transform(fx).select("id", F.col("prediction").alias("p1"))
    b = again.transform(fx).select("id", F.col("prediction").alias("p2"))
    return a.join(b, "id").select("id", "p1", "p2", (F.abs(F.col("p1") - F.col("p2")) < 1e-9).alias("same"))


# ------------------------------------------------------------- F10, F13, F16, F17, F22, F9
def _level_sql() -> str:
    return FILLED + """
, lv AS (SELECT series, pos, open - lag(open) OVER (PARTITION BY series ORDER BY d) AS dx,
                lag(open) OVER (PARTITION BY series ORDER BY d) AS lvl FROM bf),
ok AS (SELECT * FROM lv WHERE dx IS NOT NULL)"""


@register("f10_adf_lag0", with_fixture("fx_daily", _level_sql() + """
, r AS (SELECT series, regr_slope(dx, lvl) AS b, regr_sxx(dx, lvl) AS sxx, regr_syy(dx, lvl) AS syy,
               regr_sxy(dx, lvl) AS sxy, count(*) AS n FROM ok GROUP BY series)
SELECT series, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS adf_stat, CAST(n AS BIGINT) AS nobs FROM r"""))
def q_adf0(spark, sf_dir):
    out = T.adf_test(filled_daily(spark, sf_dir), BY, "_pos", "open", max_lag=0, autolag=None)
    return rounded(out.select("series", "adf_stat", "nobs"), 6)


@register("f10_adf_autolag")
def q_adf(spark, sf_dir):
    return T.adf_test(filled_daily(spark, sf_dir), BY, "_pos", "open")


@register("f13_granger_lag1", with_fixture("fx_daily", FILLED + """
, g AS (SELECT series, open AS y, lag(open) OVER w AS y1, lag(high) OVER w AS x1 FROM bf
        WINDOW w AS (PARTITION BY series ORDER BY d)),
v AS (SELECT * FROM g WHERE y1 IS NOT NULL),
m AS (SELECT series, avg(y) AS my, avg(y1) AS m1, avg(x1) AS m2, count(*) AS n FROM v GROUP BY series),
s AS (SELECT v.series, max(m.n) AS n, sum((y1 - m1) * (y1 - m1)) AS a, sum((y1 - m1) * (x1 - m2)) AS b,
             sum((x1 - m2) * (x1 - m2)) AS c, sum((y1 - m1) * (y - my)) AS p, sum((x1 - m2) * (y - my)) AS q,
             sum((y - my) * (y - my)) AS yy
      FROM v JOIN m ON v.series = m.series GROUP BY v.series),
r AS (SELECT series, n, yy - p * p / a AS ssr_r, yy - (c * p * p - 2 * b * p * q + a * q * q) / (a * c - b * b) AS ssr_u
      FROM s)
SELECT series, CAST(1 AS INTEGER) AS lag, round((ssr_r - ssr_u) / ssr_u * (n - 3), 6) AS f_stat,
       round(n * (ssr_r - ssr_u) / ssr_u, 6) AS chi2 FROM r"""))
def q_granger1(spark, sf_dir):
    out = T.granger(filled_daily(spark, sf_dir), BY, "_pos", "open", "high", 1)
    return rounded(out.select("series", "lag", "f_stat", "chi2"), 6)


@register("f13_granger")
def q_granger(spark, sf_dir):
    return T.granger(filled_daily(spark, sf_dir), BY, "_pos", "open", "high", 5)


@register("f16_fit_ar1", with_fixture("fx_daily", FILLED + """
, a AS (SELECT series, open AS y, lag(open) OVER (PARTITION BY series ORDER BY d) AS y1 FROM bf)
SELECT series, 'const' AS term, round(regr_intercept(y, y1), 4) AS coef FROM a GROUP BY series
UNION ALL SELECT series, 'open_L1', round(regr_slope(y, y1), 9) FROM a GROUP BY series"""))
def q_ar1(spark, sf_dir):
    c = T.fit_ar(filled_daily(spark, sf_dir), BY, "_pos", "open", [1]).where(F.col("term").isin("const", "open_L1"))
    coef = F.when(F.col("term") == "const", F.round(F.col("coef") * 1e4, 0) / 1e4) \
        .otherwise(F.round(F.col("coef") * 1e9, 0) / 1e9) + F.lit(0.0)
    return c.select("series", "term", coef.alias("coef"))


@register("f16_ar_forecast")
def q_ar_forecast(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    n = S.series_lengths(f, BY, "_pos")
    train = f.join(n, BY).where(F.col("_pos") <= F.col("_len") - 30).drop("_len")
    test = f.join(n, BY).where(F.col("_pos") > F.col("_len") - 30).drop("_len")
    coefs = T.fit_ar(train, BY, "_pos", "open", [1, 2], ["high", "low"])
    return T.forecast_ar(train, coefs, BY, "_pos", "open", [1, 2], test.select(*BY, "_pos", "high", "low"),
                         ["high", "low"])


@register("f16_ar1_forecast", with_fixture("fx_daily", FILLED + """
, a AS (SELECT series, pos, open AS y, lag(open) OVER (PARTITION BY series ORDER BY d) AS y1 FROM bf),
c AS (SELECT series, regr_intercept(y, y1) AS c, regr_slope(y, y1) AS f, max(pos) AS n FROM a GROUP BY series)
SELECT c.series, CAST(n + h AS BIGINT) AS pos, round(c * (1 - pow(f, h)) / (1 - f) + pow(f, h) * a.y, 3) AS forecast
FROM c JOIN a ON a.series = c.series AND a.pos = c.n, range(1, 31) t(h)"""))
def q_ar1_forecast(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    ahead = S.series_lengths(f, BY, "_pos").select(*BY, F.explode(F.sequence(F.col("_len") + 1, F.col("_len") + 30)).alias("_pos"))
    out = T.forecast_ar(f, T.fit_ar(f, BY, "_pos", "open", [1]), BY, "_pos", "open", [1], ahead)
    return rounded(out.withColumnRenamed("_pos", "pos"), 3)


#: The grid of orders of the reference.
_ORDERS = [(p, 1, q) for p in (1, 2) for q in (1, 2)]
#: ARIMA(1, 1, 0): least squares through the origin, which SQL can compute.
_110 = [(1, 1, 0)]


def _110_sql(train: str = "true") -> str:
    return FILLED + f"""
, lv AS (SELECT series, pos, open AS y, open - lag(open) OVER (PARTITION BY series ORDER BY d) AS w,
                count(*) OVER (PARTITION BY series) AS len FROM bf),
tr AS (SELECT series, pos, y, w, lag(w) OVER (PARTITION BY series ORDER BY pos) AS w1 FROM lv WHERE {train}),
phi AS (SELECT series, sum(w * w1) / sum(w1 * w1) AS f, count(w1) AS n, max(pos) AS last FROM tr WHERE w1 IS NOT NULL GROUP BY series),
res AS (SELECT tr.series, tr.pos, w - f * w1 AS e FROM tr JOIN phi ON tr.series = phi.series WHERE w1 IS NOT NULL),
fit AS (SELECT phi.series, f, n, last, s AS sse FROM phi JOIN (SELECT series, sum(e * e) AS s FROM res GROUP BY series) USING (series))"""


_110_AHEAD = """
, ah AS (SELECT fit.series, last + h AS pos, h, f, y + w * f * (1 - pow(f, h)) / (1 - f) AS forecast,
                sse / n * list_sum(list_transform(range(0, h), lambda j: pow((1 - pow(f, j + 1)) / (1 - f), 2))) AS var
         FROM fit JOIN tr ON tr.series = fit.series AND tr.pos = fit.last, range(1, 31) t(h))"""


@register("f17_arima_110", with_fixture("fx_daily", _110_sql() + """
SELECT series, round(f, 9) AS ar_l1, CAST(n AS BIGINT) AS n, round(sse / n / 1e6, 6) AS sigma2_m FROM fit"""))
def q_arima_110(spark, sf_dir):
    models, _ = A.fit_arima_grid(filled_daily(spark, sf_dir), BY, "_pos", "open", _110)
    out = models.select("series", F.col("params")[0].alias("ar_l1"), "n", (F.col("sse") / F.col("n") / 1e6).alias("sigma2_m"))
    return rounded(out, {"ar_l1": 9, "sigma2_m": 6})


@register("f17_arima_110_forecast", with_fixture("fx_daily", _110_sql() + _110_AHEAD + """
SELECT series, CAST(pos AS BIGINT) AS pos, round(forecast, 3) AS forecast, round(forecast - 1.959963984540054 * sqrt(var), 3) AS lower,
       round(forecast + 1.959963984540054 * sqrt(var), 3) AS upper FROM ah"""))
def q_arima_110_forecast(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    models, _ = A.fit_arima_grid(f, BY, "_pos", "open", _110)
    out = A.forecast_arima(f, models, BY, "_pos", "open", _110)
    return rounded(out.select("series", F.col("_pos").alias("pos"), "forecast", "lower", "upper"), 3)


@register("f17_arima_110_residuals", with_fixture("fx_daily", _110_sql() + """
SELECT series, CAST(pos AS BIGINT) AS pos, round(e, 4) AS residual FROM res"""))
def q_arima_110_residuals(spark, sf_dir):
    models, blocks = A.fit_arima_grid(filled_daily(spark, sf_dir), BY, "_pos", "open", _110)
    out = A.arima_residuals(models, blocks, BY, "_pos", _110)
    return rounded(out.select("series", F.col("_pos").alias("pos"), "residual"), 4)


@register("f19_ljung_box_residuals", with_fixture("fx_daily", _110_sql() + """
, z AS (SELECT series, pos, e - avg(e) OVER (PARTITION BY series) AS z, count(*) OVER (PARTITION BY series) AS n FROM res),
lg AS (SELECT series, n, z, lag(z, 1) OVER v AS z1, lag(z, 2) OVER v AS z2 FROM z WINDOW v AS (PARTITION BY series ORDER BY pos)),
r AS (SELECT series, max(n) AS n, sum(z * z1) / sum(z * z) AS r1, sum(z * z2) / sum(z * z) AS r2 FROM lg GROUP BY series)
SELECT series, CAST(2 AS INTEGER) AS lag, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 6) AS lb_stat,
       round(exp(-n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)) / 2), 9) AS lb_pvalue FROM r"""))
def q_ljung_residuals(spark, sf_dir):
    """Ljung-Box on a model's residuals (two lags: the p-value is closed)."""
    models, blocks = A.fit_arima_grid(filled_daily(spark, sf_dir), BY, "_pos", "open", _110)
    out = S.ljung_box(A.arima_residuals(models, blocks, BY, "_pos", _110), BY, "_pos", "residual", 2)
    return rounded(out.where("lag = 2"), {"lb_stat": 6, "lb_pvalue": 9})


@register("f17_arima_forecast")
def q_arima(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    models, _ = A.fit_arima_grid(f, BY, "_pos", "open", [(1, 1, 1)])
    return A.forecast_arima(f, models, BY, "_pos", "open", [(1, 1, 1)], h=30)


@register("f22_backtest_110", with_fixture("fx_daily", _110_sql("pos <= len - 30") + _110_AHEAD + """
, er AS (SELECT ah.series, sqrt(avg(pow(forecast - lv.y, 2))) AS rmse FROM ah JOIN lv ON lv.series = ah.series AND lv.pos = ah.pos GROUP BY ah.series),
ll AS (SELECT series, n, -n / 2 * (ln(2 * pi() * sse / n) + 1) AS ll FROM fit)
SELECT er.series, '(1, 1, 0)' AS "order", round(rmse, 4) AS rmse, round(2 * 2 - 2 * ll, 4) AS aic, round(2 * ln(n) - 2 * ll, 4) AS bic
FROM er JOIN ll ON er.series = ll.series"""))
def q_backtest_110(spark, sf_dir):
    return rounded(A.forecast_backtest(filled_daily(spark, sf_dir), BY, "_pos", "open", _110), 4)


@register("f22_forecast_backtest")
def q_backtest(spark, sf_dir):
    """All four orders, with regressors, fitted in the same passes."""
    return A.forecast_backtest(filled_daily(spark, sf_dir), BY, "_pos", "open", _ORDERS, ["high", "low"], 30)


@register("f09_isolation_anomalies")
def q_iforest(spark, sf_dir):
    f = filled_daily(spark, sf_dir)
    return isolation_anomalies(f, ["open"], ["series", "d"], contamination=0.01) \
        .select("series", "d", "open", "anomaly_score", "anomaly")
