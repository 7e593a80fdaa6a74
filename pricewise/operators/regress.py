"""Linear model fitting and search.

The lasso path needs one moment aggregation; ``pyspark.ml`` fits are
distributed and searched in parallel threads through
``CrossValidator(parallelism=...)``.  Folds come from a repeatable hash of the
row key, never from a driver-side shuffle.  Trees are in ``trees`` and
``forest``, networks in ``nets``.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.functions.linalg import fit_linear, gram, gram_matrix, linear_prediction, merge_moments
from pricewise.operators.features import split_hash
from pricewise.session import spread, written


#: Penalties of the lasso search.
ALPHAS = [float(a) for a in np.linspace(0.03, 5, 10)]


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """Fold id 0..folds-1 from the repeatable hash bucket of the key."""
    return df.withColumn(col, (split_hash(key, seed) % folds).cast("int"))


def assemble(df: DataFrame, x: Sequence[str], y: str | None = None, out: str = "features") -> DataFrame:
    va = VectorAssembler(inputCols=list(x), outputCol=out, handleInvalid="skip")
    res = va.transform(df)
    return res.withColumn("label", F.col(y).cast("double")) if y else res


def fit_ols(df: DataFrame, y: str, x: Sequence[str]) -> dict:
    """Exact least squares with intercept from one Gram aggregation."""
    return fit_linear(df, list(x), y)


def predict_ols(df: DataFrame, model: dict, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, linear_prediction(model))


def cross_validate(estimator, grid, df: DataFrame, folds: int = 5, metric: str = "rmse",
                   parallelism: int = 4, fold_col: str = "fold"):
    """K-fold search with user-supplied folds (``fold`` column)."""
    ev = RegressionEvaluator(metricName=metric, labelCol="label", predictionCol="prediction")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        foldCol=fold_col, parallelism=parallelism)
    return cv.fit(df)


def cv_scores(cv_model, grid) -> list[tuple[dict, float]]:
    return [({p.name: m[p] for p in m}, float(s)) for m, s in zip(grid, cv_model.avgMetrics)]


def fit_lasso_cv(df: DataFrame, y: str, x: Sequence[str], key: str, alphas: Sequence[float] | None = None,
                 folds: int = 5, parallelism: int = 4):
    """L1 path scored by 5-fold RMSE.  ``LinearRegression`` with
    ``elasticNetParam=1`` and no standardization minimises
    ``1/(2n) ||y - Xb||^2 + alpha ||b||_1``, the same objective."""
    alphas = list(alphas) if alphas is not None else ALPHAS
    # every fit reads the rows again: they are written once, with what a fit needs, a file to every core
    data, _ = written(spread(with_fold(assemble(df, x, y), key, folds).select("features", "label", "fold"), 1))
    lr = LinearRegression(elasticNetParam=1.0, standardization=False, maxIter=200, tol=1e-8)
    grid = ParamGridBuilder().addGrid(lr.regParam, [float(a) for a in alphas]).build()
    return cross_validate(lr, grid, data, folds, "rmse", parallelism), grid


def lasso_cd(cov: np.ndarray, cxy: np.ndarray, alpha: float, start: np.ndarray | None = None,
             tol: float = 1e-12, max_sweeps: int = 100_000) -> np.ndarray:
    """Coordinate descent for ``1/2 b'Sb - c'b + alpha |b|_1`` (covariance
    form of ``1/(2n)||y - b0 - Xb||^2 + alpha |b|_1``)."""
    p = len(cxy)
    b = np.zeros(p) if start is None else start.copy()
    for _ in range(max_sweeps):
        delta = 0.0
        for j in range(p):
            if cov[j, j] <= 0:
                b[j] = 0.0
                continue
            rho = cxy[j] - cov[j] @ b + cov[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / cov[j, j]
            delta = max(delta, abs(new - b[j]) * np.sqrt(cov[j, j]))
            b[j] = new
        if delta < tol:
            break
    return b


def lasso_path_cv(df: DataFrame, y: str, x: Sequence[str], key: str, alphas: Sequence[float] | None = None,
                  folds: int = 5, seed: int = 42) -> tuple[list[dict], dict]:
    """The whole L1 path scored by k-fold RMSE from ONE aggregation.

    Per fold the data gives (n, means, centred cross products) in a single
    grouped pass (partial-aggregated map-side, so fold sizes do not matter).
    Each training set's moments are the exact merge of the other folds'; the
    lasso is solved by covariance coordinate descent on k x k numbers (warm
    started along the path), and the held-out SSE of any coefficient vector
    follows from the fold's moments:
    ``SSE = w'G_v w + n_v (w'm_v - b0)^2`` with ``w = (-b, 1)``.
    Returns one row per alpha (mean fold RMSE, L1 norm) and the refit of the
    best alpha on all rows."""
    x = list(x)
    p = len(x)
    alphas = list(alphas) if alphas is not None else ALPHAS
    rows = gram(with_fold(df, key, folds, seed), ["fold"], x, y).collect()  # one row per fold
    parts = {int(r["fold"]): (int(r["_n"]), np.array([float(r[f"_m{i}"]) for i in range(p + 1)]),
                              gram_matrix(r, p + 1)) for r in rows}

    def solve(n, m, g, alpha, start):
        b = lasso_cd(g[:p, :p] / n, g[:p, p] / n, alpha, start)
        return b, float(m[p] - m[:p] @ b)

    scores = {a: [] for a in alphas}
    for v, (nv, mv, gv) in parts.items():
        n, m, g = merge_moments([parts[f] for f in parts if f != v])
        b = None
        for a in sorted(alphas):
            b, b0 = solve(n, m, g, a, b)
            w = np.append(-b, 1.0)
            sse = float(w @ gv @ w + nv * (w @ mv - b0) ** 2)
            scores[a].append(np.sqrt(max(sse, 0.0) / nv))
    n, m, g = merge_moments(list(parts.values()))
    out, b = [], None
    for a in sorted(alphas):
        b, b0 = solve(n, m, g, a, b)
        out.append({"alpha": float(a), "rmse": float(np.mean(scores[a])), "l1_norm": float(np.abs(b).sum()),
                    "nonzero": int((b != 0).sum()), "coef": dict(zip(x, map(float, b))), "intercept": b0})
    best = min(out, key=lambda r: r["rmse"])
    return out, {"intercept": best["intercept"], "coef": best["coef"], "alpha": best["alpha"]}


def sample_settings(space: dict, n: int, seed: int = 7) -> list[dict]:
    """Seeded random settings: tuples are (low, high) ranges (ints stay
    ints), lists are choices."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = {}
        for k, v in space.items():
            if isinstance(v, tuple):
                lo, hi = v
                s[k] = rnd.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rnd.uniform(lo, hi)
            else:
                s[k] = rnd.choice(list(v))
        out.append(s)
    return out


def fitted_models(df: DataFrame, y: str, x: Sequence[str], key: str, train_size: float = 0.8, rounds: int = 100,
                  setting: dict | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """The hold-out rows of a hash split with the ``prediction`` of every
    model fitted on the training rows alone: least squares, the best lasso of
    the path on min-max scaled inputs (ranges of the training rows), boosted
    trees.  Complete cases only."""
    from pricewise.operators.cells import numeric_features
    from pricewise.operators.features import apply_min_max, fit_min_max, train_test_split
    from pricewise.operators.trees import fit_boosted

    x = list(x)
    parts = train_test_split(df.dropna(subset=[y, *x]), key, train_size, seed)
    train, test = (parts.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    ranges = fit_min_max(train, x)
    scaled, held = apply_min_max(train, ranges, x), apply_min_max(test, ranges, x)
    setting = setting or {"max_depth": 6, "gamma": 0.0, "eta": 0.1, "subsample": 1.0, "min_child_weight": 1.0, "reg_lambda": 1.0}
    trees = fit_boosted(train, y, numeric_features(train, x), key, setting, rounds)
    return {"ols": predict_ols(test, fit_ols(train, y, x)), "lasso": predict_ols(held, lasso_path_cv(scaled, y, x, key)[1]),
            "boosted": trees.predict(test)}


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (scaler + model)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_scoring_pipeline(train: DataFrame, x: Sequence[str], y: str) -> PipelineModel:
    """Scaler + linear model pipeline used by batch and stream scoring."""
    from pyspark.ml.feature import MinMaxScaler

    stages = [VectorAssembler(inputCols=list(x), outputCol="raw", handleInvalid="keep"),
              MinMaxScaler(inputCol="raw", outputCol="features"),
              LinearRegression(featuresCol="features", labelCol=y, regParam=0.0)]
    return Pipeline(stages=stages).fit(train)
