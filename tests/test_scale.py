"""Steps that must hold up on large tables, on small rows of their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pricewise.operators import cells as C
from pricewise.operators import forest as I
from pricewise.operators import nets as N
from pricewise.operators import rank as R
from pricewise.operators import regress as M
from pricewise.sources import markup as MK
from pricewise.sources import pages as PG


def _tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pages_of_one_partition_are_parsed_by_many_tasks(spark):
    html = ("<h1>a</h1><ul><li><a href='/x'>t</a><li>no link</ul>"
            "<table class='d'><tr><td class='k'>Size:</td><td><strong>3</strong></td></tr></table>")
    rows = [(i, f"u{i}", html) for i in range(200)] + [(7, "u7", html), (None, "u", html), (300, "u300", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    links = PG.extract_listing_links(pages)
    pairs = PG.explode_attributes(PG.extract_key_values(pages, "d", "k"))
    heads = PG.headline_blocks(pages)
    for out, per_page in ((links, 2), (pairs, 1), (heads, 1)):
        assert out.count() == per_page * 202
        assert _tasks(out) > 1
    assert {(r.attr, r["value"]) for r in pairs.collect()} == {("Size:", "3")}
    assert PG.extract_key_values(pages, "d", "k").where("attrs IS NULL").count() == 1


def test_importance_above_the_limit_equals_the_one_below(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else float(rng.integers(0, 40)), float(rng.normal()), None if i % 7 == 0 else "abc"[int(rng.integers(0, 3))],
             None if i % 13 == 0 else float(rng.integers(0, 99) + i % 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y double")
    # whole numbers about a mean of 0: sums are exact, so equal gains are equal in any order
    train = df.where(F.col("y").isNotNull() & (I.split_share("id", 42) < 0.7)).agg(F.sum("y").alias("s"), F.min("id").alias("id")).first()
    df = df.withColumn("y", F.when(F.col("id") == train.id, F.col("y") - train.s).otherwise(F.col("y")))
    features = C.category_features({"c": ["a", "b", "c"]}) + C.numeric_features(df, ["a", "b"], bins=16)
    below = {r.feature: r.importance for r in I.forest_importance(df, "y", features, "id", trees=12).collect()}
    for small in (10_000, 40):  # all in subtrees, most in shared levels
        above = {r.feature: r.importance for r in I.forest_importance(df, "y", features, "id", trees=12, limit=10, small=small).collect()}
        assert above.keys() == below.keys()
        assert all(abs(above[f] - below[f]) < 1e-6 for f in below)


def test_lasso_fits_read_a_spread_table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(3 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").coalesce(1)
    seen = []
    original = M.cross_validate
    M.cross_validate = lambda lr, grid, data, *rest: seen.append(data) or original(lr, grid, data, *rest)
    try:
        cv, grid = M.fit_lasso_cv(df, "y", ["a", "b"], "id", alphas=[0.03, 1.0])
    finally:
        M.cross_validate = original
    assert _tasks(seen[0]) > 1 and seen[0].columns == ["features", "label", "fold"]
    path, _ = M.lasso_path_cv(df, "y", ["a", "b"], "id", alphas=[0.03, 1.0])
    for (_, score), row in zip(M.cv_scores(cv, grid), path):
        assert abs(score - row["rmse"]) < 1e-3


def test_network_gradients_leave_out_units_that_only_pad(spark):
    rng = np.random.default_rng(1)
    settings = [{"hidden": h, "alpha": 0.001, "step": 0.01} for h in (2, 5, 3)]
    nets = N.Nets.begin(settings, [0, 1], 2, 7)
    x, y, fold = rng.normal(size=(60, 2)), rng.normal(size=60), rng.integers(0, 2, 60)
    scales = [N.Scale(x.min(axis=0), np.ptp(x, axis=0), 0.1, 1.3, 60)] * 2
    for m, (i, _) in enumerate(zip(nets.setting, nets.fold)):
        order, layers = N._by_unit({c: p[m:m + 1] for c, p in nets.parts.items()})
        assert len(layers) == settings[i]["hidden"]
    grads, held = N.sums_of(nets, scales, x, y, fold)
    assert not N.sums_of(nets, scales, x, y, fold, scored=False)[1].any() and (held > 0).all()

    def loss(values, m):
        s, v = scales[0], nets.fold[m]
        z, t = (x - s.low) / s.width, (y - s.mean) / s.spread
        one = nets.with_flat(values).only(np.array([m]))
        return ((N.forward(one.parts, z[fold != v])[1][:, 0] - t[fold != v]) ** 2).sum() / 2

    flat = nets.flat()
    for m in range(len(flat)):
        for p in np.flatnonzero(flat[m]):
            up, down = flat.copy(), flat.copy()
            up[m, p] += 1e-6
            down[m, p] -= 1e-6
            assert abs((loss(up, m) - loss(down, m)) / 2e-6 - grads[m, p]) < 1e-4 * (1 + abs(grads[m, p]))


PLAIN_PAGES = [
    "<!DOCTYPE html><html lang=hu><style>p{a:b}</style><script>var t=\"</p>\";1<2</script><p class='a  b'>&nbsp;x&amp;lt;<br/>y<p>z</p >",
    "<!-- c-d --><UL><LI Class=\"k l\">1<li>2<a href='/x?a=1&amp;b=2' b B=3>t</a><img src=x/><script></script></UL>tail &am",
    "<table class=d><tr><td class='k'>Size:<td><STRONG> 3&#x41;</STRONG></table></div>", "no tags & none", "",
]
ODD_PAGES = [
    "<p>a < b</p><li>1", "<a x= y>1</a>", "<a x='1'y=2>1</a>", "<a x='1>1</a>", "<li>1<!-- a--- ><li>2", "<!--><li>1-->",
    "<script>1</ script><li>2", "<script/><li>1", "<script><!-- </script><li>1", "<script>1</style></script><li>1", "<style>x",
    "<a1-b>1", "<a\x0bb>1", "<li\x00>1", "<?pi><li>1", "<![bad[<li>1", "</><li>1", "<ſcript>1</script>", "<li", "x<",
]


def test_plain_markup_gives_the_elements_of_the_parser():
    def view(found):
        return [(e.tag, list(e.attrs.items()), e.inner, e.text(), "".join(e.words[:e.first])) for e in found]

    pages = PLAIN_PAGES + ODD_PAGES + [a + b for a in PLAIN_PAGES for b in PLAIN_PAGES + ODD_PAGES]
    for html in pages:
        assert view(MK.elements(html)) == view(MK.parsed(html)), html
    assert sum(len(MK.elements(html)) for html in PLAIN_PAGES) == 17


def test_plain_markup_needs_no_parser(monkeypatch):
    def feed(self, data):
        raise AssertionError(data)

    monkeypatch.setattr(MK._Reader, "feed", feed)
    assert [[e.tag for e in MK.elements(html)] for html in PLAIN_PAGES[2:4]] == [["table", "tr", "td", "td", "strong"], []]


def test_each_page_is_parsed_once_when_rows_are_split(spark):
    good = "<table class='d'><td class='k'>Size:</td><td><strong>3</strong></td></table>"
    rows = [(1, good), (2, "<p>none</p>"), (3, good.replace("'k'", "'x'")), (None, good), (5, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    kept, rejected = PG.quarantine_bad_rows(PG.extract_key_values(pages, "d", "k"))
    for out in (kept, rejected, PG.widen_attributes(kept, ["Size:"])):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.page_id for r in kept.collect()} == {1, None}
    assert {(r.page_id, r.reject_reason) for r in rejected.collect()} == {
        (2, "no attribute table"), (3, "fewer keys than values"), (5, "no attribute table")}


def test_column_quantiles_count_batches_of_rows_where_they_lie(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 9 == 0 else float(rng.normal()), float("nan") if i % 50 == 0 else float(rng.integers(0, 100)), None, i % 7)
            for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d int").repartition(5)
    probs, cols = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0], ["a", "b", "c", "d"]
    for part in (df, df.where("id < 300"), df.where("id < 0")):  # brackets of a sketch, of all rows, none
        out = R.column_quantiles(part, cols, probs)
        want = {(c, r.p): r.q for c in cols for r in R.exact_quantiles(part, c, probs).collect()}
        assert {(r["column"], r.p): r.q for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan  # rows reach no join that deals them out by column
    assert R.few_values(df, cols, 7) == {"d": [float(i) for i in range(7)]}
    assert [f.edges for f in C.numeric_features(df, ["d", "c"])] == [tuple(map(float, range(6))), ()]


def test_bins_by_bisection_count_the_edges_below(spark):
    edges = tuple(float(i) for i in range(0, 26, 2))
    values = [None, float("nan"), float("-inf"), *[i / 2 for i in range(-2, 54)]]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", C.Feature("x", edges=edges).code().alias("c"))
    assert [r.c for r in df.collect()] == [0, len(edges) + 1, *[1 + sum(v > e for e in edges) for v in values[2:]]]


def test_subtrees_are_grown_by_many_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 40)), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    features, seen = C.numeric_features(df, ["a", "b"], bins=16), []
    original = I.cut_lineage
    I.cut_lineage = lambda out: seen.append(original(out)) or seen[-1]
    try:
        I.forest_importance(df, "y", features, "id", trees=24, limit=10)
    finally:
        I.cut_lineage = original
    assert seen[-1].columns == ["tree", "feature", "gain"] and _tasks(seen[-1]) > 4


def test_network_steps_read_blocks_of_rows(spark):
    rng = np.random.default_rng(6)
    data = np.concatenate((rng.integers(0, 3, (700, 1)), rng.normal(5, 3, (700, 2)), rng.normal(40, 9, (700, 1))), axis=1)
    rows = spark.createDataFrame([(int(f), float(a), float(b), float(y)) for f, a, b, y in data], "fold int, x0 double, x1 double, y double").coalesce(2)
    blocks = N.packed(rows, 2, size=100).persist()
    found = [(r.fold, np.frombuffer(bytes(r.block)).reshape(3, r.n)) for r in blocks.collect()]
    assert max(b.shape[1] for _, b in found) == 100 and sum(b.shape[1] < 100 for _, b in found) <= 2 * 3
    assert sorted((f, *r) for f, b in found for r in b.T) == sorted(tuple(r) for r in data)

    scales = N.fold_scales(rows, 2, 3)
    nets = N.Nets.begin([{"hidden": h, "alpha": 0.001, "step": 0.01} for h in (2, 5, 3)], [0, 1, 2, 3], 2, 7)
    grads, held = N._pass(blocks, nets, scales, 2)
    fold, x, y = data[:, 0], data[:, 1:3], data[:, 3]
    for m, (g, sse) in enumerate(zip(grads, held)):  # by hand, each model on its own scale
        s, p = scales[nets.fold[m]], {c: v[m] for c, v in nets.parts.items()}
        z, t, train = (x - s.low) / s.width, (y - s.mean) / s.spread, fold != nets.fold[m]
        act = z @ p["w"] + p["b"]
        error = np.maximum(act, 0) @ p["out"] + p["bias"] - t
        back = (error[:, None] * (act > 0) * p["out"])[train]
        want = np.concatenate(((z[train].T @ back).reshape(-1), back.sum(axis=0), np.maximum(act, 0)[train].T @ error[train], [error[train].sum()]))
        assert np.allclose(g, want, rtol=1e-9, atol=1e-9) and np.isclose(sse, (error[~train] ** 2).sum() * s.spread ** 2)
    blocks.unpersist()
