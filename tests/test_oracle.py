"""Every registered query with oracle SQL must equal DuckDB on the same
parquet tables (row count, column names, order-insensitive values); queries
without SQL (random or iterative fits) must return the rows that have to be."""

from __future__ import annotations

import numpy as np
import pytest

from pricewise.plans import registry

from oracle_compare import compare, duck

registry.load_all()
WITH_SQL = sorted(registry.ORACLE)
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLE))


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, sf_dir, name):
    r = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE[name], sf_dir)
    assert r["cols_ok"], r.get("cols")
    assert r["spark_rows"] == r["duck_rows"]
    assert r["values_ok"], r.get("diff")


#: What has to hold of the queries without SQL: number of rows, or None where the data decide (then at least one).
ROWS = {"a09_save_load_pipeline": None, "e02_forest_scores": 4 * 72, "e08_forest_importance": 14, "f09_isolation_anomalies": None,
        "f10_adf_autolag": 5, "f13_granger": 25, "f16_ar_forecast": 150, "f17_arima_forecast": 150, "f19_ljung_box_pvalue": 25,
        "f22_forecast_backtest": 20, "g03_lasso_cv": 10, "g03_lasso_cv_ml": 10, "g04_boosted_search": 50, "g07_fitted_models": 3,
        "g10_normality_ad": 1, "g10_ols_normality_ad": 1}
#: Run by their own tests on smaller searches.
SEARCHES = {"e02_forest_scores", "g04_boosted_search", "g05_net_search"}


@pytest.mark.parametrize("name", sorted(set(ROWS_ONLY) - SEARCHES))
def test_rows_only(spark, sf_dir, name):
    rows = registry.QUERIES[name](spark, sf_dir).collect()
    wanted = ROWS.get(name)
    assert len(rows) == wanted if wanted else rows
    for r in rows:  # numbers are numbers, probabilities are probabilities
        for c, v in r.asDict().items():
            assert not (isinstance(v, float) and np.isnan(v)), c
            if isinstance(v, float) and c.endswith(("_p", "p_value", "pvalue")):
                assert 0 <= v <= 1
