"""Operator-level checks on hand-made frames and known closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.functions import dist
from pricewise.operators import rank, score
from pricewise.operators.series import _durbin_levinson
from pricewise.sources import pages as PG


def test_ad_pvalue_hand_check():
    # a = 0.752 is the 5% point of the normality statistic
    assert dist.ad_normal_pvalue(0.752, 1e12) == pytest.approx(0.050, abs=1e-3)


def test_mackinnon_hand_check():
    # t = -2.86 is the 5% critical value with a constant
    assert dist.mackinnon_p_constant(-2.86) == pytest.approx(0.050, abs=2e-3)
    assert dist.mackinnon_p_constant(3.0) == 1.0
    assert dist.mackinnon_p_constant(-20.0) == 0.0


def test_chi2_and_f_tails():
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-6)
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-6)


def test_durbin_levinson_ar1():
    # AR(1) autocorrelations r_k = phi^k give pacf (phi, 0, 0, ...)
    phi = 0.6
    r = np.array([phi ** k for k in range(0, 6)])
    p = _durbin_levinson(r, 5)
    assert p[0] == 1.0 and p[1] == pytest.approx(phi)
    assert np.allclose(p[2:], 0.0, atol=1e-12)


def test_exact_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=2000), np.full(1000, 0.25)])  # one value holds a third
    grp = np.where(np.arange(len(vals)) % 2 == 0, "a", "b")
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(grp, vals)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, round(r.p, 6)): r.q for r in rank.exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g in ("a", "b"):
        ref = np.quantile(vals[grp == g], probs)  # linear interpolation
        for p, q in zip(probs, ref):
            assert got[(g, round(p, 6))] == pytest.approx(q, rel=1e-12, abs=1e-12)


def test_global_rank_is_dense_and_unique(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000)
    ranked = rank.with_global_rank(df, ["k"], "r").select("k", "r").collect()
    assert sorted(r.r for r in ranked) == list(range(1, 5001))
    by_k = sorted(ranked, key=lambda r: r.k)
    assert all(a.r < b.r for a, b in zip(by_k, by_k[1:]))


def test_key_values_last_wins_and_rejects(spark):
    table = ('<table class="hirdetesadatok"><tr><td class="bal pontos"> A: </td><td><strong> 1 </strong></td></tr>'
             '<tr><td class="bal pontos">B:</td><td><strong>2 &amp; 3</strong></td></tr>'
             '<tr><td class="bal pontos">A:</td><td><strong>9</strong></td></tr></table>')
    broken = '<table class="hirdetesadatok"><tr><td>A:</td><td><strong>1</strong></td></tr></table>'
    df = spark.createDataFrame([(1, table), (2, "<p>no table</p>"), (3, broken)], "page_id long, html string")
    kv = PG.extract_key_values(df, "hirdetesadatok", "bal pontos").orderBy("page_id").collect()
    assert [(a.key, a.value) for a in kv[0].attrs] == [("B:", "2 & 3"), ("A:", "9")]
    assert kv[0].reject_reason is None
    assert kv[1].attrs is None and kv[1].reject_reason == "no attribute table"
    assert kv[2].attrs is None and kv[2].reject_reason == "fewer keys than values"
    wide = PG.widen_attributes(PG.quarantine_bad_rows(PG.extract_key_values(df, "hirdetesadatok", "bal pontos"))[0],
                                ["A:", "B:"]).collect()
    assert wide[0]["A:"] == "9" and wide[0]["B:"] == "2 & 3"


def test_listing_links(spark):
    html = '<ul><li><a href="/x">  X &lt;1&gt; </a></li><li>plain</li><li><a class="c" href="/y"><b>Y</b></a></li></ul>'
    rows = PG.extract_listing_links(spark.createDataFrame([(7, html)], "page_id long, html string")) \
        .orderBy("block_pos").collect()
    assert [(r.title, r.href, r.reject_reason) for r in rows] == [
        ("X <1>", "/x", None), (None, None, "no anchor in block"), ("Y", "/y", None)]


def test_page_requests(spark):
    t = spark.createDataFrame([("https://a/p{}",)], "template string")
    urls = [r.url for r in PG.page_requests(t).orderBy("page_pos").collect()]
    assert urls == [f"https://a/p{n}" for n in range(1, 252, 50)]


def test_request_vocabulary_and_fallthrough(spark):
    assert len(score.flag_columns()) == 51
    rows = [(1, 1, 1.0, 1, 1, 1, "lada", "2021", "normal", "pickup", "x", "gaz", "cvt"),
            (2, 1, 1.0, 1, 1, 1, "audi", "2011", "roncs", "kombi", "digital", "benzin", "manual")]
    df = spark.createDataFrame(rows, "id int, km int, trunk double, cylinder int, power int, hp int, brand string, "
                                     "year string, condition string, design string, aircon string, fuel string, "
                                     "gearbox string")
    strict = {r.id: r for r in score.encode_request(df).collect()}
    assert strict[1].reject_reason == "unknown brand: lada"
    assert strict[2].reject_reason == "unknown condition: roncs"
    compat = {r.id: r for r in score.encode_request(df, compat=True).collect()}
    r1 = compat[1]
    assert r1.reject_reason is None
    assert sum(r1[c] for c in score.flag_columns() if c.startswith("brand_")) == 0
    assert r1.year_2019 == 1 and r1.design_varosi == 1 and r1.fuel_hibriddizel == 1 and r1.gearbox_szekvencia == 1
    assert compat[2].reject_reason == "unknown condition: roncs"


def test_linear_scorer_matches_numpy(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(1, 50)], "id int, km double, trunk double")
    means, stds = score.fit_scaler(df, ["km", "trunk"])
    x = np.arange(1, 50, dtype=float)
    assert means["km"] == pytest.approx(x.mean()) and stds["trunk"] == pytest.approx((x * x).std())
    assert math.isfinite(stds["km"])


def test_log_tail_is_smooth_and_finite():
    assert dist.log_norm_cdf(-10.0) == pytest.approx(dist.log_norm_cdf(-9.9999999), rel=1e-6)
    assert dist.log_norm_cdf(-40.0) == pytest.approx(-804.608442, rel=1e-8)


def test_row_at_past_the_end(spark):
    from pricewise.operators import columns as C
    df = spark.range(10).select((F.col("id") * 2).alias("v"))
    assert [r.v for r in C.row_at(df, ["v"], 3, "v").collect()] == [6]
    assert C.row_at(df, ["v"], 10, "v").collect() == []


def test_granger_uses_complete_cases(spark):
    from pricewise.operators.tsmodels import granger
    rng = np.random.default_rng(4)
    n = 300
    x, y = rng.normal(size=n) * 1e4 + 3e5, rng.normal(size=n)
    x[::5] = np.nan
    rows = [("s", i + 1, float(y[i]), None if np.isnan(x[i]) else float(x[i])) for i in range(n)]
    got = granger(spark.createDataFrame(rows, "k string, pos long, y double, x double"), ["k"], "pos", "y", "x", 2).collect()

    def ssr(cols, target):
        a = np.column_stack([np.ones(len(target)), *cols])
        beta = np.linalg.lstsq(a, target, rcond=None)[0]
        return float(((target - a @ beta) ** 2).sum())

    for r in got:
        lags = range(1, r.lag + 1)
        ok = [i for i in range(r.lag, n) if not any(np.isnan(x[i - k]) for k in lags)]
        yl = [np.array([y[i - k] for i in ok]) for k in lags]
        xl = [np.array([(x[i - k] - 3e5) / 1e4 for i in ok]) for k in lags]
        t = np.array([y[i] for i in ok])
        a, b = ssr(yl, t), ssr([*yl, *xl], t)
        assert r.f_stat == pytest.approx((a - b) / b / r.lag * (len(t) - 2 * r.lag - 1), rel=1e-8)
