"""Cross-checks between model implementations."""

from __future__ import annotations

import numpy as np
import pytest

from pricewise.plans import registry

registry.load_all()


def test_moment_lasso_equals_pyspark_ml_search(spark, sf_dir):
    fast = registry.QUERIES["g03_lasso_cv"](spark, sf_dir).orderBy("alpha").collect()
    ml = registry.QUERIES["g03_lasso_cv_ml"](spark, sf_dir).collect()
    ml_rmse = sorted((float(r.setting.split(":")[1].strip(" }")), r.rmse) for r in ml)
    assert [round(r.alpha, 9) for r in fast] == [round(a, 9) for a, _ in ml_rmse]
    for r, (_, rm) in zip(fast, ml_rmse):
        assert r.rmse == pytest.approx(rm, rel=1e-6)
    # more L1 penalty never gives a larger L1 norm; the best alpha is in the grid
    norms = [r.l1_norm for r in fast]
    assert all(a >= b - 1e-12 for a, b in zip(norms, norms[1:]))
    assert sum(r.best for r in fast) == 1


def test_lasso_cd_zero_penalty_is_ols():
    from pricewise.operators.regress import lasso_cd

    rng = np.random.default_rng(3)
    X = rng.normal(size=(500, 4))
    y = X @ np.array([1.0, -2.0, 0.0, 0.5]) + rng.normal(size=500)
    Xc, yc = X - X.mean(0), y - y.mean()
    b = lasso_cd(Xc.T @ Xc / 500, Xc.T @ yc / 500, 0.0)
    assert np.allclose(b, np.linalg.lstsq(Xc, yc, rcond=None)[0], atol=1e-8)
