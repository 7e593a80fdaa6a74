"""ARIMA by blocks against plain recursions, and NULL series keys in every
per-series operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.operators import arima as A
from pricewise.operators import relate, tsmodels
from pricewise.operators import series as S
from pricewise.session import ship_package

BY = ["series"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def simulate(n, phi, theta, d, beta=0.0, seed=0):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n), rng.normal(size=n).cumsum()
    w = np.zeros(n)
    dx = np.diff(x, n=d, prepend=x[:1]) if d else x
    for t in range(n):
        w[t] = e[t] + beta * dx[t] + sum(f * w[t - k] for k, f in enumerate(phi, 1) if t >= k)
        w[t] += sum(f * e[t - k] for k, f in enumerate(theta, 1) if t >= k)
    for _ in range(d):
        w = w.cumsum()
    return w, x


@pytest.fixture(scope="module")
def walks(spark):
    """An ARIMA(1,1,1) with a regressor, a NULL key among the series."""
    rows = []
    for i, key in enumerate(("a", None)):
        y, x = simulate(700, [0.5], [0.4], 1, 2.0, i)
        rows += [(key, t, float(v), float(u)) for t, (v, u) in enumerate(zip(y, x), 1)]
    return spark.createDataFrame(rows, "series string, _pos long, y double, x double").repartition(4).cache()


def recursion(w, x, p, q, params, const=False):
    """Shocks one by one."""
    c = int(const)
    phi, beta, theta = params[c:c + p], params[c + p:c + p + x.shape[1]], params[c + p + x.shape[1]:]
    e = np.zeros(len(w))
    for t in range(p, len(w)):
        e[t] = w[t] - (params[0] if c else 0) - sum(f * w[t - k] for k, f in enumerate(phi, 1)) - beta @ x[t]
        e[t] -= sum(f * e[t - k] for k, f in enumerate(theta, 1) if t >= k)
    return e


@pytest.mark.parametrize("q", [0, 1, 2, 3])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 50, 401])
def test_shock_filter(q, n):
    rng = np.random.default_rng(n)
    theta, z = rng.uniform(-0.4, 0.4, q), rng.normal(size=(n, 3))
    want = np.zeros_like(z)
    for t in range(n):
        want[t] = z[t] - sum((f * want[t - k] for k, f in enumerate(theta, 1) if t >= k), np.zeros(3))
    assert np.allclose(A.shock_filter(theta, z), want)


@pytest.mark.parametrize("p, q, const", [(1, 1, True), (2, 2, False), (0, 2, True), (2, 0, True), (1, 3, False)])
def test_blocks_give_the_sums_of_the_whole_series(p, q, const):
    rng = np.random.default_rng(p + 10 * q)
    shape, w = A.Shape(p, q, 1, const), rng.normal(size=(203, 2))
    params = rng.uniform(-0.3, 0.3, shape.size)
    shocks = recursion(w[:, 0], w[:, 1:], p, q, params, const)
    for size in (1, 2, 7, 50, 203):
        parts = []
        for lo in range(0, len(w), size):
            halo = min(lo, 10)
            parts.append(A.block_sums(A.Block(2 + lo, halo, w[lo - halo:lo + size]), shape, 1, params))
        sse, jtj, jte, n, last, _ = A.carried(parts, shape, params)
        assert sse == pytest.approx((shocks ** 2).sum()) and n == len(w) - p
        assert np.allclose(last, shocks[::-1][:q])

        def at(x):
            return (recursion(w[:, 0], w[:, 1:], p, q, x, const) ** 2).sum()
        step = 1e-6 * np.eye(shape.size)
        assert np.allclose([(at(params + s) - at(params - s)) / 2e-6 for s in step], 2 * jte, rtol=1e-3, atol=1e-3)
        assert np.allclose(jtj, jtj.T) and np.linalg.eigvalsh(jtj).min() > 0


def test_fit_finds_the_model_and_ignores_blocks(walks):
    orders = [(1, 1, 1), (2, 1, 2)]
    fits = {}
    for size in (64, 1 << 16):
        models, _ = A.fit_arima_grid(walks, BY, "_pos", "y", orders, ["x"], block_rows=size)
        fits[size] = {(r.series, r.model): r for r in models.collect()}
    for key, r in fits[64].items():
        assert np.allclose(r.params, fits[1 << 16][key].params, atol=1e-6) and r.sse == pytest.approx(fits[1 << 16][key].sse)
        assert r.sse <= r.first_sse  # never worse than Hannan-Rissanen
    assert len(fits[64]) == 4
    for series in ("a", None):
        assert np.allclose(fits[64][series, 0].params, [0.5, 2.0, 0.4], atol=0.15)
        assert fits[64][series, 1].sse <= fits[64][series, 0].sse * 1.001


def test_a_grid_equals_single_fits(walks):
    both = {(r.series, r.model): r for r in A.fit_arima_grid(walks, BY, "_pos", "y", [(1, 1, 0), (2, 1, 0)])[0].collect()}
    for i, order in enumerate([(1, 1, 0), (2, 1, 0)]):
        for r in A.fit_arima_grid(walks, BY, "_pos", "y", [order])[0].collect():
            assert np.allclose(r.params, both[r.series, i].params) and r.sse == pytest.approx(both[r.series, i].sse)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_residuals_and_forecast(spark, walks, d):
    order = (1, d, 1)
    models, blocks = A.fit_arima_grid(walks, BY, "_pos", "y", [order], block_rows=100)
    rows = walks.where("series is null").orderBy("_pos").collect()
    y = np.array([r.y for r in rows])
    w = np.diff(y, n=d)
    m = next(r for r in models.collect() if r.series is None)
    shocks = recursion(w, np.zeros((len(w), 0)), 1, 1, np.array(m.params), const=d == 0)
    got = {r._pos: r.residual for r in A.arima_residuals(models, blocks, BY, "_pos", [order]).where("series is null").collect()}
    assert sorted(got) == list(range(d + 2, len(y) + 1))
    assert np.allclose([got[d + 1 + t] for t in range(1, len(w))], shocks[1:], atol=1e-8)
    # forecast: the recursion goes on without shocks
    c = int(d == 0)
    levels, last_w, last_e = list(y), w[-1], shocks[-1]
    for _ in range(5):
        v = (m.params[0] if c else 0) + m.params[c] * last_w + m.params[c + 1] * last_e
        last_w, last_e = v, 0.0
        levels.append(v + {0: 0, 1: levels[-1], 2: 2 * levels[-1] - levels[-2]}[d])
    ahead = A.forecast_arima(walks, models, BY, "_pos", "y", [order], h=5).where("series is null").orderBy("_pos").collect()
    assert np.allclose([r.forecast for r in ahead], levels[-5:]) and [r._pos for r in ahead] == list(range(701, 706))
    width = [r.upper - r.lower for r in ahead]
    assert all(a <= b + 1e-9 for a, b in zip(width, width[1:]))


def test_missing_values_have_no_shock(walks):
    holed = walks.withColumn("y", F.when(F.col("_pos").between(300, 304), None).otherwise(F.col("y")))
    models, blocks = A.fit_arima_grid(holed, BY, "_pos", "y", [(1, 1, 1)], block_rows=128)
    assert {r.n for r in models.collect()} == {700 - 2 - 7}  # five values take part in seven differences and lags
    res = A.arima_residuals(models, blocks, BY, "_pos", [(1, 1, 1)])
    assert res.groupBy("series").count().collect()[0]["count"] == 700 - 9 and res.where("residual is null").count() == 0


@pytest.mark.parametrize("make", [
    lambda d: tsmodels.adf_test(d, BY, "_pos", "y"),
    lambda d: tsmodels.granger(d, BY, "_pos", "y", "x", 2),
    lambda d: S.future_frame(d.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("_pos").cast("int"))), BY, "d", "_pos", 5, ["x"], ["y"]),
    lambda d: S.last_n_holdout(d, BY, "_pos", 30),
    lambda d: tsmodels.forecast_ar(d, tsmodels.fit_ar(d, BY, "_pos", "y", [1, 2]), BY, "_pos", "y", [1, 2],
                                   S.series_lengths(d, BY, "_pos").select(*BY, (F.col("_len") + 1).alias("_pos"))),
    lambda d: A.forecast_backtest(d, BY, "_pos", "y", [(1, 1, 1)], ["x"], 20),
    lambda d: S.time_series_folds(d, BY, "_pos", 3, 20),
    lambda d: relate.rolled_history(d, BY, "_pos", "_pos", 2),
    lambda d: S.diff(d, BY, "_pos", ["y"]),
], ids=["adf", "granger", "future", "holdout", "ar", "backtest", "folds", "rolled", "diff"])
def test_a_null_series_keeps_its_rows(walks, make):
    counts = {r.series: r["count"] for r in make(walks).groupBy("series").count().collect()}
    assert set(counts) == {"a", None} and counts["a"] == counts[None] > 0


def test_diff_numbers_what_is_left(spark):
    rows = [("s", t, None if t in (4, 9) else float(t * t)) for t in range(1, 15)]
    out = S.diff(spark.createDataFrame(rows, "series string, _pos long, x double"), BY, "_pos", ["x"])
    lagged = S.add_lags(out, BY, "_pos", "x", [1]).orderBy("_pos").collect()
    assert [r._pos for r in lagged] == list(range(1, 10))
    assert [r.x_lag_value_1 for r in lagged][1:] == [r.x for r in lagged][:-1]
