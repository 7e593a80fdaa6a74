"""Network search, quantile selection, kernel densities, and plans that build
without a job."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.operators import nets as N
from pricewise.operators import profile as P
from pricewise.operators import rank as R
from pricewise.operators.series import overlap_products
from pricewise.plans import registry
from pricewise.session import ship_package, written

registry.load_all()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# -- networks

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, (600, 2))
    y = np.abs(x[:, 0]) * 10 + x[:, 1] + 50
    rows = [(i, float(a), None if i % 50 == 0 else float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(3).cache()


def test_gradients():
    rng = np.random.default_rng(0)
    settings = [{"hidden": 3}, {"hidden": 2}]
    nets = N.Nets.begin(settings, [0, 1, 2], 2, 5)
    x, y, fold = rng.normal(size=(40, 2)), rng.normal(size=40), rng.integers(0, 2, 40)
    scales = [N.Scale(np.zeros(2), np.ones(2), 0.1, 2.0, 1)] * 3
    grads, held = N.sums_of(nets, scales, x, y, fold)

    def loss(flat):
        parts = nets.with_flat(flat).parts
        error = N.forward(parts, x)[1] - ((y - 0.1) / 2)[:, None]
        return 0.5 * np.where(fold[:, None] != nets.fold[None, :], error ** 2, 0).sum(axis=0)
    flat, eps = nets.flat(), 1e-6
    for j in range(flat.shape[1]):
        step = np.zeros_like(flat)
        step[:, j] = eps
        live = (nets.with_flat(flat + step).flat() - flat)[:, j] > 0
        numeric = (loss(flat + step) - loss(flat - step)) / (2 * eps)
        assert np.allclose(grads[live, j], numeric[live], atol=1e-4)
    error = N.forward(nets.parts, x)[1] - ((y - 0.1) / 2)[:, None]
    assert np.allclose(held, 4 * np.where(fold[:, None] == nets.fold[None, :], error ** 2, 0).sum(axis=0))


def test_scales_ignore_the_held_out_fold(points):
    rows = points.dropna().select((F.col("id") % 3).cast("int").alias("fold"), F.col("a").alias("x0"), "y")
    shifted = rows.withColumn("x0", F.when(F.col("fold") == 1, F.col("x0") + 1000).otherwise(F.col("x0")))
    a, b = N.fold_scales(rows, 1, 3)[1], N.fold_scales(shifted, 1, 3)[1]
    assert (a.low, a.width, a.mean, a.spread, a.rows) == (b.low, b.width, b.mean, b.spread, b.rows)
    assert N.fold_scales(shifted, 1, 3)[0].width[0] > 900


def test_search_learns_and_goes_on_after_a_loss(spark, points, tmp_path):
    settings = [{"hidden": h, "alpha": 1e-4, "step": s} for h in (2, 4) for s in (0.001, 0.1)]
    rungs = (4, 40)

    def search(folder):
        return N.search_nets(points, "y", ["a", "b"], "id", settings, str(folder), folds=3, rungs=rungs, kept=2)
    one = search(tmp_path / "one")
    rows = one.scores.collect()
    assert {r.setting for r in rows if r.rung == 0} == {0, 1, 2, 3} and len({r.setting for r in rows if r.rung == 1}) == 2
    assert len([r for r in rows if r.rung == 1 and r.setting == one.best]) == 3  # the winner is scored on every fold
    # the first rung alone is there: the rest is done again, with the same result
    spark.read.parquet(str(tmp_path / "one/rung-0")).write.parquet(str(tmp_path / "two/rung-0"))
    two = search(tmp_path / "two")
    key = lambda r: (r.rung, r.setting, r.fold)
    assert two.best == one.best
    assert [r.rmse for r in sorted(two.scores.collect(), key=key)] == pytest.approx([r.rmse for r in sorted(rows, key=key)])
    out = one.predict(points).collect()
    assert all((r.prediction is None) == (r.b is None) for r in out)
    assert np.corrcoef(np.array([(r.prediction, r.y) for r in out if r.b is not None]).T)[0, 1] > 0.5


# -- quantiles

@pytest.mark.parametrize("sketch", [10_000, 40])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_equal_numpy(spark, monkeypatch, sketch, by):
    """Also where brackets come from a coarse sketch and a value holds a third of the rows."""
    monkeypatch.setattr(R, "SKETCH", sketch)
    rng = np.random.default_rng(2)
    rows = [(("a", "b", None)[i % 3], 5.0 if i % 3 == 0 else float(v)) for i, v in enumerate(rng.normal(size=6000).round(3) * 10)]
    rows += [("one", 1.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = {(r.g if by else None, r.p): r.q for r in R.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", probs, by).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g if by else None, []).append(x)
    want = {(g, p): np.quantile(x, p) for g, x in groups.items() for p in probs}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("name", ["d04_describe", "d05_describe_by_brand", "d08_box_stats_by_condition", "b14_filter_upper_fence",
                                  "d09_histogram_by_design", "d10_binned_pairs", "d17_cramers_matrix", "e01_impute_mode",
                                  "e11_standardize", "e12_min_max_scale"])
def test_building_a_plan_runs_no_job(spark, sf_dir, name):
    registry.QUERIES["d03_schema_profile"](spark, sf_dir)  # reading a table's schema is a job of its own
    spark.sparkContext.setJobGroup(f"plan-{name}", "building")
    try:
        registry.QUERIES[name](spark, sf_dir)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")
    finally:
        spark.sparkContext.setJobGroup("tests", "")


def test_density_equals_the_sum_of_kernels(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=500), "b": np.concatenate((rng.exponential(size=300), [40.0])), "c": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, xs in values.items() for v in xs] + [("flat", 1.0), ("flat", 1.0), (None, 3.0), ("a", None)]
    got = P.group_density(spark.createDataFrame(rows, "g string, x double"), "x", "g", grid=60).collect()
    assert {r.level for r in got} == set(values) and len(got) == 180
    for r in got:
        x = values[r.level]
        h = x.std(ddof=1) * len(x) ** -0.2
        assert r.x == pytest.approx(x.min() - 2 * h + r.gi * (x.max() - x.min() + 4 * h) / 59)
        assert r.density == pytest.approx(np.exp(-((r.x - x) / h) ** 2 / 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("n, halo, lags", [(1, 0, 3), (5, 2, 10), (400, 30, 30), (1000, 0, 300)])
def test_overlap_products(n, halo, lags):
    z = np.random.default_rng(n).normal(size=n)
    want = [sum(z[t] * z[t - k] for t in range(max(halo, k), n)) for k in range(lags + 1)]
    assert np.allclose(overlap_products(z, halo, lags), want)


def test_written_tables_come_back(spark):
    df, path = written(spark.range(5).select("id", F.lit(None).cast("string").alias("s")))
    assert df.columns == ["id", "s"] and df.count() == 5 and path
