"""Per-series tests and models: ADF (F10), Granger (F13) and AR (F16);
ARIMA is in ``arima``.

Pattern for all of them: lag columns from a blocked window
(``series.with_window_columns``), one aggregation of cross products per
series (and per candidate lag, as masked sums), then a small solve per series
in ``applyInPandas`` on one Gram row.  Forecast recursions see only the last
``max(p, q)`` rows and the ``h`` future rows of a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.functions.dist import chi2_sf, f_sf, mackinnon_p_constant
from pricewise.operators.rank import null_safe_join
from pricewise.operators.series import series_lengths, with_window_columns


def _key_schema(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by]


def _masked_gram(df: DataFrame, by: Sequence[str], cols: Sequence[str], masks: dict[int, object]) -> DataFrame:
    """Uncentred sums of products of ``cols`` (a ones column first) for each
    named row mask: ``_n{m}``, ``_g{m}_{i}_{j}``."""
    names = ["_one", *cols]
    base = df.withColumn("_one", F.lit(1.0))
    if len(masks) == 1:
        # a single mask is a row filter: plain sums, no per-cell CASE
        (m, cond), = masks.items()
        base = base.where(cond)
        masks = {m: F.lit(True)}
    aggs = []
    for m, cond in masks.items():
        aggs.append(F.count(F.when(cond, 1)).alias(f"_n{m}"))
        for i in range(len(names)):
            for j in range(i, len(names)):
                aggs.append(F.sum(F.when(cond, F.col(names[i]) * F.col(names[j]))).alias(f"_g{m}_{i}_{j}"))
    return base.groupBy(*by).agg(*aggs)


def _gram_from(row, m: int, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            v = row.get(f"_g{m}_{i}_{j}")
            g[i, j] = g[j, i] = 0.0 if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)
    return g


def _ols_sub(g: np.ndarray, idx: list[int], yi: int, n: int):
    """OLS on the Gram sub-block ``idx`` (its first entry is the ones column)
    for target column ``yi``: (beta, ssr, inv(X'X) without the constant).

    Works on moments about the fitted rows' own means, with every regressor
    scaled to unit length, so columns of very different size lose no digits.
    ``beta[0]`` is the constant; row and column 0 of the inverse are NaN."""
    xs = idx[1:]
    mean = g[0] / n
    centred = g - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred)[xs], 0.0))
    scale[scale == 0] = 1.0
    unit = centred[np.ix_(xs, xs)] / np.outer(scale, scale)
    cross = centred[xs, yi] / scale
    inv_unit = np.linalg.pinv(unit, rcond=1e-12, hermitian=True) if xs else unit
    slope = inv_unit @ cross
    ssr = max(float(centred[yi, yi] - slope @ cross), 0.0)
    beta = np.empty(len(idx))
    beta[1:] = slope / scale
    beta[0] = mean[yi] - beta[1:] @ mean[xs]
    inv = np.full((len(idx), len(idx)), np.nan)
    inv[1:, 1:] = inv_unit / np.outer(scale, scale)
    return beta, ssr, inv


def _complete_lags(names: Sequence[str]):
    """Largest k such that the first k of ``names`` are all not NULL."""
    if not names:
        return F.lit(0)
    k = F.when(F.col(names[0]).isNull(), 0)
    for i, c in enumerate(names[1:], 1):
        k = k.when(F.col(c).isNull(), i)
    return k.otherwise(len(names))


def _llf(ssr: float, n: int) -> float:
    return -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)


# ---------------------------------------------------------------- F10 ADF
def adf_test(df: DataFrame, by: Sequence[str], pos: str, col: str, max_lag: int | None = None,
             autolag: str | None = "AIC", alpha: float = 0.05) -> DataFrame:
    """augmented Dickey-Fuller test with a constant:
    ``by..., adf_stat, p_value, used_lag, nobs, stationary``.

    The largest lag defaults to ``ceil(12 (n/100)^(1/4))`` (capped at
    ``n/2 - 2``) per series.  With ``autolag='AIC'`` all lags up to it are
    compared on the same rows (one Gram per series, nested sub-blocks), and
    the chosen lag is refitted on its own rows (a second Gram where lags
    beyond each series' choice are masked out): two aggregations in total.
    """
    by = list(by)
    nobs = df.where(F.col(col).isNotNull()).groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("_nobs"))
    if max_lag is None:
        ml = F.greatest(F.lit(0), F.least(F.ceil(12.0 * F.pow((F.col("_nobs") + 1) / 100.0, 0.25)),
                                          F.floor((F.col("_nobs") + 1) / 2) - 2)).cast("int")
        lmax = int(nobs.select(ml.alias("m")).agg(F.max("m")).collect()[0][0] or 0)
    else:
        ml = F.lit(int(max_lag))
        lmax = int(max_lag)
    mls = nobs.select(*by, ml.alias("_ml"))
    cols = {"_lvl": lambda w: F.lag(col, 1).over(w), "_dx": lambda w: F.col(col) - F.lag(col, 1).over(w)}
    lagged = with_window_columns(df, by, pos, 1, cols)
    lagged = with_window_columns(lagged, by, pos, max(lmax, 1),
                                 {f"_dl{k}": (lambda w, k=k: F.lag("_dx", k).over(w)) for k in range(1, lmax + 1)})
    xs = ["_lvl", *[f"_dl{k}" for k in range(1, lmax + 1)], "_dx"]
    # centre by the series means for conditioning (the ones column absorbs it)
    mu = lagged.groupBy(*by).agg(F.avg(col).alias("_mu"), F.avg("_dx").alias("_mdx"))
    lagged = null_safe_join(null_safe_join(lagged, mu, by), mls, by)
    # complete cases: a row counts for a fit only if all lags of that fit exist
    lagged = lagged.withColumn("_whole", _complete_lags([f"_dl{k}" for k in range(1, lmax + 1)]))
    lagged = lagged.withColumn("_lvl", F.col("_lvl") - F.col("_mu")).withColumns(
        {c: F.col(c) - F.col("_mdx") for c in xs if c != "_lvl"}).fillna(0.0, subset=xs[1:-1])
    ok = F.col("_dx").isNotNull() & F.col("_lvl").isNotNull()
    k = len(xs) + 1
    yi = k - 1
    key_schema = _key_schema(lagged, by)

    if autolag:
        g_common = _masked_gram(lagged, [*by, "_ml"], xs, {0: ok & (F.col(pos) >= F.col("_ml") + 2) & (F.col("_whole") >= F.col("_ml"))})

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, r in pdf.iterrows():
                row = r.to_dict()
                m, n = int(row["_ml"]), int(row["_n0"])
                g = _gram_from(row, 0, k)
                best, best_ic = 0, None
                for L in range(0, m + 1):
                    idx = [0, 1, *range(2, 2 + L)]
                    _, ssr, _ = _ols_sub(g, idx, yi, n)
                    ic = -2 * _llf(ssr, n) + 2 * len(idx)
                    if best_ic is None or ic < best_ic - 1e-12:
                        best, best_ic = L, ic
                out.append([*[row[b] for b in by], best])
            return pd.DataFrame(out, columns=[*by, "_L"])

        chosen = g_common.groupBy(*by).applyInPandas(pick, ", ".join(key_schema + ["_L int"]))
    else:
        chosen = mls.select(*by, F.col("_ml").alias("_L"))
    refit = null_safe_join(lagged, chosen, by)
    refit = refit.withColumns({f"_dl{j}": F.when(F.col("_L") >= j, F.col(f"_dl{j}")).otherwise(F.lit(0.0))
                               for j in range(1, lmax + 1)})
    g_fit = _masked_gram(refit, [*by, "_L"], xs, {0: ok & (F.col(pos) >= F.col("_L") + 2) & (F.col("_whole") >= F.col("_L"))})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            row = r.to_dict()
            L, n = int(row["_L"]), int(row["_n0"])
            idx = [0, 1, *range(2, 2 + L)]
            beta, ssr, inv = _ols_sub(_gram_from(row, 0, k), idx, yi, n)
            s2 = ssr / (n - len(idx))
            t = beta[1] / math.sqrt(inv[1, 1] * s2)
            p = mackinnon_p_constant(t)
            out.append([*[row[b] for b in by], float(t), float(p), L, n, bool(p <= alpha)])
        return pd.DataFrame(out, columns=[*by, "adf_stat", "p_value", "used_lag", "nobs", "stationary"])

    schema = ", ".join(key_schema + ["adf_stat double", "p_value double", "used_lag int", "nobs long",
                                     "stationary boolean"])
    return g_fit.groupBy(*by).applyInPandas(fit, schema)


# ---------------------------------------------------------------- F13 Granger
def granger(df: DataFrame, by: Sequence[str], pos: str, y: str, x: str, max_lag: int = 5) -> DataFrame:
    """does ``x`` help predict ``y``?  For every lag L = 1..max_lag,
    nested OLS on the rows with L lags available: ``by..., lag, f_stat,
    f_p, chi2, chi2_p, lr, lr_p``."""
    by = list(by)
    mu = df.groupBy(*by).agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    c = null_safe_join(df, mu, by).withColumn("_y", F.col(y) - F.col("_my")) \
        .withColumn("_x", F.col(x) - F.col("_mx"))
    make = {}
    for k in range(1, max_lag + 1):
        make[f"_yl{k}"] = (lambda w, k=k: F.lag("_y", k).over(w))
        make[f"_xl{k}"] = (lambda w, k=k: F.lag("_x", k).over(w))
    lagged = with_window_columns(c, by, pos, max_lag, make)
    cols = [*[f"_yl{k}" for k in range(1, max_lag + 1)], *[f"_xl{k}" for k in range(1, max_lag + 1)], "_y"]
    # The row sets of the lags are nested (lag L uses the complete cases of
    # lags 1..L), so one Gram per (series, bucket) with bucket = number of
    # complete lags gives every lag's Gram as a suffix sum over buckets: one
    # aggregation of plain sums instead of max_lag masked ones.
    pairs = [F.when(F.col(f"_yl{k}").isNotNull(), F.col(f"_xl{k}")).alias(f"_p{k}") for k in range(1, max_lag + 1)]
    bucketed = (lagged.select("*", *pairs).withColumn("_b", _complete_lags([f"_p{k}" for k in range(1, max_lag + 1)]))
                .where(F.col("_y").isNotNull() & (F.col("_b") >= 1)).fillna(0.0, subset=cols[:-1]))
    g = _masked_gram(bucketed, [*by, "_b"], cols, {0: F.lit(True)})
    schema = ", ".join(_key_schema(g, by) + ["lag int", "f_stat double", "f_p double", "chi2 double",
                                             "chi2_p double", "lr double", "lr_p double"])
    k = len(cols) + 1
    yi = k - 1

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = [r.to_dict() for _, r in pdf.iterrows()]
        grams = {int(r["_b"]): (_gram_from(r, 0, k), int(r["_n0"])) for r in rows}
        keys = [rows[0][b] for b in by] if rows else []
        for L in range(1, max_lag + 1):
            parts = [grams[b] for b in grams if b >= L]
            if not parts:
                continue
            gm, n = sum(p[0] for p in parts), sum(p[1] for p in parts)
            ylags = list(range(1, 1 + L))
            xlags = list(range(1 + max_lag, 1 + max_lag + L))
            _, ssr_r, _ = _ols_sub(gm, [0, *ylags], yi, n)
            _, ssr_u, _ = _ols_sub(gm, [0, *ylags, *xlags], yi, n)
            dfd = n - 2 * L - 1
            fstat = (ssr_r - ssr_u) / ssr_u / L * dfd
            chi = n * (ssr_r - ssr_u) / ssr_u
            lr = -2 * (_llf(ssr_r, n) - _llf(ssr_u, n))
            out.append([*keys, L, fstat, f_sf(fstat, L, dfd), chi, chi2_sf(chi, L), lr, chi2_sf(lr, L)])
        return pd.DataFrame(out, columns=[*by, "lag", "f_stat", "f_p", "chi2", "chi2_p", "lr", "lr_p"])

    return g.groupBy(*by).applyInPandas(fn, schema)


# ---------------------------------------------------------------- F16 AR
def fit_ar(df: DataFrame, by: Sequence[str], pos: str, y: str, lags: Sequence[int],
           exog: Sequence[str] = ()) -> DataFrame:
    """F16: AR with constant and exogenous regressors fitted on rows with all
    lags present: ``by..., term, coef`` (terms ``const``, ``{y}.L{k}``,
    exog names) plus ``_ssr``, ``_n`` and ``_sigma2``."""
    by = list(by)
    lags = list(lags)
    make = {f"_yl{k}": (lambda w, k=k: F.lag(y, k).over(w)) for k in lags}
    lagged = with_window_columns(df, by, pos, max(lags), make)
    xs = [*[f"_yl{k}" for k in lags], *exog]
    base = lagged.where(F.col(pos) > max(lags))
    from pricewise.functions.linalg import gram, solve_ols

    g = gram(base, by, xs, y)
    names = ["const", *[f"{y}_L{k}" for k in lags], *exog]
    schema = ", ".join(_key_schema(g, by) + ["term string", "coef double"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            res = solve_ols(r.to_dict(), len(xs))
            keys = [r[b] for b in by]
            vals = [res["intercept"], *map(float, res["beta"])]
            out += [[*keys, nm, v] for nm, v in zip(names, vals)]
            out += [[*keys, "_ssr", res["ssr"]], [*keys, "_n", float(res["n"])],
                    [*keys, "_sigma2", res["ssr"] / res["n"]]]
        return pd.DataFrame(out, columns=[*by, "term", "coef"])

    return g.groupBy(*by).applyInPandas(fn, schema)


def forecast_ar(df: DataFrame, coefs: DataFrame, by: Sequence[str], pos: str, y: str, lags: Sequence[int],
                future: DataFrame, exog: Sequence[str] = ()) -> DataFrame:
    """F16 forecast: recursive h-step prediction past the last row of each
    series using ``future`` rows (``by..., pos, exog...``).  Each series
    contributes only its last ``max(lags)`` rows plus its future rows."""
    by = list(by)
    p = max(lags)
    n = series_lengths(df, by, pos)
    tail = null_safe_join(df, n, by).where(F.col(pos) > F.col("_len") - p) \
        .select(*by, pos, F.col(y).cast("double").alias("_y"), *[F.lit(None).cast("double").alias(e) for e in exog],
                F.lit(False).alias("_fut"))
    fut = future.select(*by, pos, F.lit(None).cast("double").alias("_y"),
                        *[F.col(e).cast("double").alias(e) for e in exog], F.lit(True).alias("_fut"))
    names = [f"{y}_L{k}" for k in lags]
    terms = ["const", *names, *exog, "_ssr", "_n", "_sigma2"]
    wide = coefs.withColumn("term", F.concat(F.lit("c_"), "term")).groupBy(*by) \
        .pivot("term", [f"c_{t}" for t in terms]).agg(F.first("coef"))
    rows = null_safe_join(tail.unionByName(fut), wide, by)
    schema = ", ".join(_key_schema(rows, by) + [f"`{pos}` long", "forecast double"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        hist = {int(r[pos]): r["_y"] for _, r in pdf[~pdf["_fut"]].iterrows()}
        out = []
        c0 = pdf.iloc[0]
        for _, r in pdf[pdf["_fut"]].iterrows():
            t = int(r[pos])
            v = float(c0["c_const"])
            for k, nm in zip(lags, names):
                v += float(c0[f"c_{nm}"]) * hist[t - k]
            for e in exog:
                v += float(c0[f"c_{e}"]) * float(r[e])
            hist[t] = v
            out.append([*[c0[b] for b in by], t, v])
        return pd.DataFrame(out, columns=[*by, pos, "forecast"])

    return rows.groupBy(*by).applyInPandas(fn, schema)
