"""The driver contract: entry(), queries() and oracle_sql()."""

from __future__ import annotations

import __spark_entry__ as E  # noqa: E402


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) > 100
    assert set(o) <= set(q)
    assert all(isinstance(s, str) and s.strip() for s in o.values())


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    first = df.schema
    rows = df.collect()
    assert len(rows) > 0
    assert E.entry(spark).schema == first
    assert "fuel_generalized" in df.columns
