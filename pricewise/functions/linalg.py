"""Gram-first least squares.

Every regression of the package is one aggregation of cross products per
group (``sum(x_i * x_j)``, ``sum(x_i * y)``, ``count``) over centred columns,
followed by a k x k solve per group.  The aggregation is partial-aggregated
map-side, so any group size works; the solves run in ``applyInPandas`` on
one small row per group (or on the driver for a single model, where only
k x k numbers are collected).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _pairs(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram(df: DataFrame, by: Sequence[str], cols: Sequence[str], y: str | None = None,
         center: bool = True, where=None) -> DataFrame:
    """Per group: ``_n``, column means ``_m{i}`` (when ``center``) and sums
    of products ``_g{i}_{j}`` of the (centred) columns, ``y`` last.

    Rows with a NULL in any used column are skipped (complete cases).
    """
    by = list(by)
    names = list(cols) + ([y] if y else [])
    base = df
    if where is not None:
        base = base.where(where)
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull()
    base = base.where(ok).select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    k = len(names)
    n = F.count(F.lit(1))
    if center:  # one pass: Spark merges partial covariances stably
        sums = [(F.covar_pop(f"_x{i}", f"_x{j}") * n).alias(f"_g{i}_{j}") for i, j in _pairs(k)]
        means = [F.avg(f"_x{i}").alias(f"_m{i}") for i in range(k)]
    else:
        sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_g{i}_{j}") for i, j in _pairs(k)]
        means = []
    return base.groupBy(*by).agg(n.alias("_n"), *means, *sums)


def merge_moments(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Exact pooled (n, means, centred sums of products) of disjoint groups
    given each group's own (Chan et al. pairwise update)."""
    n = sum(p[0] for p in parts)
    m = sum(p[0] * p[1] for p in parts) / n
    g = sum(p[2] + p[0] * np.outer(p[1] - m, p[1] - m) for p in parts)
    return n, m, g


def gram_matrix(row, k: int) -> np.ndarray:
    g = np.empty((k, k))
    for i, j in _pairs(k):
        g[i, j] = g[j, i] = float(row[f"_g{i}_{j}"])
    return g


def solve_ols(row, p: int, intercept: bool = True) -> dict:
    """OLS from one gram row of ``p`` regressors plus y (centred form).

    Returns coefficients (intercept first when requested), standard errors,
    SSR, TSS, n and the residual degrees of freedom."""
    k = p + 1
    g = gram_matrix(row, k)
    n = int(row["_n"])
    xtx, xty, yy = g[:p, :p], g[:p, p], g[p, p]
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0] if p else np.zeros(0)
    ssr = float(yy - beta @ xty) if p else float(yy)
    ssr = max(ssr, 0.0)
    dof = n - p - (1 if intercept else 0)
    s2 = ssr / dof if dof > 0 else np.nan
    try:
        inv = np.linalg.inv(xtx) if p else np.zeros((0, 0))
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(xtx)
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 0)) if p else np.zeros(0)
    out = {"beta": beta, "se": se, "ssr": ssr, "tss": float(yy), "n": n, "dof": dof, "inv": inv}
    if intercept and "_m0" in row:
        means = np.array([float(row[f"_m{i}"]) for i in range(k)])
        b0 = means[p] - beta @ means[:p]
        # var(b0) = s2/n + m' cov m
        var0 = s2 / n + means[:p] @ (inv * s2) @ means[:p] if p else s2 / n
        out["intercept"] = float(b0)
        out["intercept_se"] = float(np.sqrt(max(var0, 0)))
    return out


def ols_by_group(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str) -> DataFrame:
    """Per-group OLS with intercept: ``by..., term, coef, se, t`` plus model
    rows ``term = '_ssr' / '_n' / '_r2'`` in ``coef``."""
    by = list(by)
    x = list(x)
    g = gram(df, by, x, y)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema.fields if f.name in by]
                       + ["term string", "coef double", "se double", "t double"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            res = solve_ols(r, len(x))
            keys = [r[b] for b in by]
            rows.append([*keys, "intercept", res["intercept"], res["intercept_se"],
                         res["intercept"] / res["intercept_se"] if res["intercept_se"] else np.nan])
            for i, c in enumerate(x):
                se = res["se"][i]
                rows.append([*keys, c, float(res["beta"][i]), float(se), float(res["beta"][i] / se) if se else np.nan])
            r2 = 1 - res["ssr"] / res["tss"] if res["tss"] else np.nan
            rows += [[*keys, "_ssr", res["ssr"], np.nan, np.nan], [*keys, "_n", float(res["n"]), np.nan, np.nan],
                     [*keys, "_r2", r2, np.nan, np.nan]]
        return pd.DataFrame(rows, columns=[*by, "term", "coef", "se", "t"])

    if by:
        return g.groupBy(*by).applyInPandas(fn, schema)
    return g.mapInPandas(lambda it: (fn(p) for p in it), schema)


def fit_linear(df: DataFrame, x: Sequence[str], y: str) -> dict:
    """Single OLS model: one aggregation, k x k numbers to the driver."""
    row = gram(df, [], list(x), y).collect()[0].asDict()
    res = solve_ols(row, len(x))
    return {"intercept": res["intercept"], "coef": dict(zip(x, map(float, res["beta"]))),
            "se": dict(zip(x, map(float, res["se"]))), "ssr": res["ssr"], "n": res["n"],
            "r2": 1 - res["ssr"] / res["tss"] if res["tss"] else float("nan")}


def linear_prediction(model: dict):
    """Column expression ``b0 + sum(b_i * x_i)`` (scoring is a projection)."""
    expr = F.lit(float(model["intercept"]))
    for c, b in model["coef"].items():
        expr = expr + F.lit(float(b)) * F.col(c).cast("double")
    return expr
