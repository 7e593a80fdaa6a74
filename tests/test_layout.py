"""Answers must not depend on block sizes, partitions or row order."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.operators import series as S
from pricewise.operators.anomaly import isolation_anomalies
from pricewise.operators.rank import exact_quantiles
from pricewise.sources.markup import elements, select

BY = ["series"]


@pytest.fixture(scope="module")
def holed(spark):
    """Two series (one with a NULL key) in which every second value and a
    stretch of ten are NULL."""
    walk = np.random.default_rng(7).normal(size=200).cumsum()
    rows = [(key, t, None if t % 2 or 100 < t < 111 else float(x))
            for key in ("a", None) for t, x in enumerate(walk, 1)]
    return spark.createDataFrame(rows, "series string, _pos long, x double")


def rows(df):
    """Sorted rows, numbers to 9 digits."""
    return sorted((tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()))


@pytest.mark.parametrize("make", [
    lambda d, b: S.acf(d, BY, "_pos", "x", 6, block_rows=b),
    lambda d, b: S.pacf(d, BY, "_pos", "x", 6, block_rows=b),
    lambda d, b: S.ljung_box(d, BY, "_pos", "x", 6, block_rows=b),
    lambda d, b: S.backfill(d, BY, "_pos", ["x"], block_rows=b),
    lambda d, b: S.rolling_stats(S.backfill(d, BY, "_pos", ["x"]), BY, "_pos", "x", 5, block_rows=b),
    lambda d, b: S.pct_change(d, BY, "_pos", "x", 3, block_rows=b),
    lambda d, b: S.growth_features(d, BY, "_pos", "x", 2, 5, block_rows=b),
], ids=["acf", "pacf", "ljung_box", "backfill", "rolling", "pct_change", "growth"])
def test_block_size_changes_nothing(holed, make):
    assert rows(make(holed, 8)) == rows(make(holed, 1_000_000))


def test_acf_counts_values_not_positions(holed):
    x = np.array([r.x for r in holed.where("series = 'a' and x is not null").orderBy("_pos").collect()])
    z = x - x.mean()
    want = [float((z[k:] * z[:len(z) - k]).sum() / (z * z).sum()) for k in range(7)]
    got = S.acf(holed, BY, "_pos", "x", 6, block_rows=8)
    for key in (F.col("series") == "a", F.col("series").isNull()):
        assert np.allclose([r.acf for r in got.where(key).orderBy("lag").collect()], want, atol=1e-12)


def test_isolation_labels_ignore_partitions(spark):
    base = spark.range(3000).select("id", (F.xxhash64("id") % 1000 / 10.0).alias("x"),
                                    F.when(F.col("id") % 500 == 0, 900.0).otherwise(F.col("id") % 7 * 1.0).alias("y"))
    one, seven = (rows(isolation_anomalies(base.repartition(n), ["x", "y"], ["id"], trees=20)) for n in (1, 7))
    assert one == seven
    assert sum(r[-1] == "-1" for r in one) <= 30


def test_isolation_of_few_rows(spark):
    few = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], "id long, x double")
    assert isolation_anomalies(few, ["x"], ["id"], trees=3).count() == 3


def test_quantiles_plan_has_no_nested_loop(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    q = exact_quantiles(df, "x", [0.1, 0.5])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = np.quantile(np.arange(1000) % 97, [0.1, 0.5])
    assert np.allclose([r.q for r in q.orderBy("p").collect()], want)


def test_markup_behind_a_malformed_declaration():
    for bad in ("<![bogus[x]]>", "<![bogus", "<!DOCTYPE html [<!BOGUS x>]>", "<![if x"):
        found = elements(f"<ul><li>one</li>{bad}><li>two</li></ul>")
        assert [e.text() for e in select(found, "li")][-1] == "two", bad


def test_markup_of_odd_pages():
    assert elements(None) == [] and elements("") == [] and elements("no tags") == []
    found = elements("<UL><LI class='a  b'>1<li>2<br>x</ul><p>&nbsp;t&amp;lt; <![bad[")
    assert [e.text() for e in select(found, "li")][-1] == "2x"
    assert select(found, "li", "a b") and select(found, "li", "b") and not select(found, "li", "a")[1:]
    assert select(found, "p")[0].text().startswith("t&lt;")
