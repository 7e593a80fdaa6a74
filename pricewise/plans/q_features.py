"""Checked queries for joins (C) and feature operators (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewise.operators import features as E
from pricewise.operators import profile as P
from pricewise.operators import relate as R
from pricewise.plans.listings import clean_raw_listings
from pricewise.plans.registry import register, rounded
from pricewise.sources.fixtures import fixture, with_fixture, with_fixtures
from pricewise.sources.tables import load

SHARE_SQL = "CAST(('0x' || substr(md5('42' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296"


# ------------------------------------------------------------- C: joins
@register("c01_join_group_stats", with_fixture("fx_listings", """
SELECT f.id, f.design, f.price, round(g.std, 6) AS std, round(g.avg, 6) AS avg, CAST(g.n AS BIGINT) AS n
FROM fx_listings f LEFT JOIN (SELECT design, stddev_samp(price) AS std, avg(price) AS avg, count(price) AS n
                              FROM fx_listings WHERE design IS NOT NULL GROUP BY design) g
ON f.design = g.design"""))
def q_group_stats(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "design", "price")
    return rounded(R.join_group_stats(fx, ["design"], "price"), 6).select(
        "id", "design", "price", "std", "avg", "n")


@register("c02_lookup_map", with_fixture("fx_listings", """
SELECT f.id, f.brand, r.r_name AS region FROM fx_listings f
LEFT JOIN (SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) r
ON f.brand = r.n_name"""))
def q_lookup(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "brand")
    small = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"),
                                               F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("brand"), F.col("r_name").alias("region"))
    return R.lookup_map(fx, small, "brand").select("id", "brand", "region")


_SHIP_DAILY = """
SELECT o.o_orderpriority AS series, CAST(l.l_shipdate AS DATE) AS d, count(*) AS shipped
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderpriority, CAST(l.l_shipdate AS DATE)"""


@register("c03_align_on_date", with_fixture("fx_daily", f"""
, s AS ({_SHIP_DAILY})
SELECT coalesce(a.series, s.series) AS series, coalesce(a.d, s.d) AS d, a.open, CAST(s.shipped AS BIGINT) AS shipped
FROM fx_daily a FULL OUTER JOIN s ON a.series = s.series AND a.d = s.d"""))
def q_align(spark, sf_dir):
    a = fixture(spark, sf_dir, "fx_daily").select("series", "d", "open")
    s = spark.sql(_SHIP_DAILY).withColumn("shipped", F.col("shipped").cast("long"))
    return R.align_on_date(a, s, ["series", "d"]).select("series", "d", "open", "shipped")


_PAIR_COLS = ["condition", "design", "wheel_drive"]


@register("c05_pair_counts", with_fixture("fx_listings", " UNION ALL ".join(
    f"SELECT '{x}' AS var1, '{y}' AS var2, CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b, "
    f"CAST(count(*) AS BIGINT) AS count FROM fx_listings WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}"
    for x in _PAIR_COLS for y in _PAIR_COLS if x != y)))
def q_pairs(spark, sf_dir):
    return R.pair_counts(fixture(spark, sf_dir, "fx_listings"), _PAIR_COLS)


@register("c06_rolled_history", with_fixture("fx_daily", """
, p AS (SELECT series, d, open, row_number() OVER (PARTITION BY series ORDER BY d) AS pos FROM fx_daily)
SELECT r.series, r.d, r.open, l.d AS window_end
FROM p l JOIN p r ON l.series = r.series AND r.pos BETWEEN l.pos - 3 AND l.pos"""))
def q_rolled(spark, sf_dir):
    from pricewise.operators.series import positions
    daily = positions(fixture(spark, sf_dir, "fx_daily"), ["series"], "d")
    out = R.rolled_history(daily, ["series"], "_pos", "d", max_shift=3)
    return out.select("series", "d", "open", "window_end")


@register("c07_append_rows", with_fixtures(["fx_listings", "fx_raw"], """
SELECT id, price, brand, NULL AS fuel FROM fx_listings
UNION ALL SELECT id, CAST(trim(substr(replace(coalesce(discount_raw, price_raw), chr(160), ''), 1,
                 greatest(length(replace(coalesce(discount_raw, price_raw), chr(160), '')) - 2, 0))) AS DOUBLE) AS price,
                 split_part(title, ' ', 1) AS brand, fuel FROM fx_raw"""))
def q_append(spark, sf_dir):
    a = fixture(spark, sf_dir, "fx_listings").select("id", "price", "brand")
    b = clean_raw_listings(fixture(spark, sf_dir, "fx_raw")).select(
        "id", F.col("price").cast("double").alias("price"), "brand", "fuel")
    return R.append_rows(a, b).select("id", "price", "brand", "fuel")


@register("c08_drop_by_key", with_fixture("fx_listings", """
SELECT id, price FROM fx_listings WHERE id NOT IN (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)"""))
def q_anti(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "price")
    bad = load(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)) \
        .select(F.col("o_orderkey").alias("id"))
    return R.drop_by_key(fx, bad, "id")


@register("c04_reindex_dates", """
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
x AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT c.d, round(x.v, 6) AS value, CAST(x.n AS BIGINT) AS orders FROM cal c LEFT JOIN x ON c.d = x.d""")
def q_reindex(spark, sf_dir):
    cal = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    daily = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")) \
        .agg(F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).alias("orders"))
    return rounded(R.reindex_dates(cal, daily, "d"), 6)


# ARIMA orders of the forecast grid (p in 1..2, d = 1, q in 1..2) per series
@register("c09_parameter_grid", with_fixture("fx_daily", """
SELECT s.series, p, d, q, CAST(s.n AS BIGINT) AS days
FROM (SELECT series, count(*) AS n FROM fx_daily GROUP BY series) s,
     (SELECT unnest([1, 2]) AS p), (SELECT unnest([1]) AS d), (SELECT unnest([1, 2]) AS q)"""))
def q_grid(spark, sf_dir):
    series = fixture(spark, sf_dir, "fx_daily").groupBy("series").agg(F.count(F.lit(1)).alias("days"))
    return R.expand_grid(series, p=[1, 2], d=[1], q=[1, 2]).select("series", "p", "d", "q", "days")


# ------------------------------------------------------------- E: features
@register("e01_impute_mode", with_fixture("fx_listings", """
SELECT id, coalesce(wheel_drive, (SELECT wheel_drive FROM fx_listings WHERE wheel_drive IS NOT NULL
                                  GROUP BY wheel_drive ORDER BY count(*) DESC, wheel_drive LIMIT 1)) AS wheel_drive,
       coalesce(design, (SELECT design FROM fx_listings WHERE design IS NOT NULL
                         GROUP BY design ORDER BY count(*) DESC, design LIMIT 1)) AS design
FROM fx_listings"""))
def q_impute_mode(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "wheel_drive", "design")
    return E.impute_mode(fx, ["wheel_drive", "design"])


# Levels of the driver data, declared because they name columns.
ONE_HOT_LEVELS = {"condition": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
                  "design": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}


def _one_hot_sql() -> str:
    flags = [f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\""
             for c, levels in ONE_HOT_LEVELS.items() for v in levels[1:]]
    return with_fixture("fx_listings", f"SELECT id, price, {', '.join(flags)} FROM fx_listings")


@register("e03_one_hot", _one_hot_sql())
def q_one_hot(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "price", "condition", "design")
    return E.one_hot(fx, ["condition", "design"], ONE_HOT_LEVELS)


@register("e03_category_levels", with_fixture("fx_listings", """
SELECT DISTINCT 'condition' AS "column", condition AS value FROM fx_listings WHERE condition IS NOT NULL
UNION ALL SELECT DISTINCT 'design', design FROM fx_listings WHERE design IS NOT NULL"""))
def q_category_levels(spark, sf_dir):
    return E.category_levels(fixture(spark, sf_dir, "fx_listings"), ["condition", "design"])


_SMOOTH = ["kilometers", "power", "trunk", "price"]


def _smooth_sql() -> str:
    stack = " UNION ALL ".join(
        f"SELECT id, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM fx_listings" for c in _SMOOTH)
    probs = ", ".join(str(i / 10) for i in range(11))
    bin_expr = " + ".join(f"CAST(value > e[{i}] AS INTEGER)" for i in range(2, 11))
    pivot = ", ".join(f"max(CASE WHEN \"column\" = '{c}' THEN nv END) AS \"{c}_Handled_Outlier\"" for c in _SMOOTH)
    return with_fixture("fx_listings", f"""
, long AS ({stack}),
q AS (SELECT "column", quantile_cont(value, [{probs}]) AS e, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.75) AS q3 FROM long WHERE value IS NOT NULL GROUP BY "column"),
b AS (SELECT l.id, l."column", l.value, q.q1, q.q3, CASE WHEN l.value IS NOT NULL THEN {bin_expr} END AS bin
      FROM long l JOIN q ON l."column" = q."column"),
m AS (SELECT "column", bin, quantile_cont(value, 0.5) AS med FROM b WHERE bin IS NOT NULL GROUP BY "column", bin),
n AS (SELECT b.id, b."column",
             CASE WHEN b.value > b.q3 + 1.5 * (b.q3 - b.q1) OR b.value < b.q1 - 1.5 * (b.q3 - b.q1)
                  THEN m.med ELSE b.value END AS nv
      FROM b LEFT JOIN m ON b."column" = m."column" AND b.bin = m.bin)
SELECT id, {pivot} FROM n GROUP BY id""")


@register("e04_smooth_outliers_by_bin", _smooth_sql())
def q_smooth(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", *_SMOOTH)
    out = E.smooth_outliers_by_bin(fx, _SMOOTH, bins=10)
    return rounded(out.select("id", *[f"{c}_Handled_Outlier" for c in _SMOOTH]), 6)


_VAR_COLS = ["price", "kilometers", "trunk", "cylinder", "power", "age"]


@register("e05_variance_filter", with_fixture("fx_listings", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(least(var_pop({c}), max({c}) - min({c})), 4) AS variance, "
    f"least(var_pop({c}), max({c}) - min({c})) > 0 AS keep FROM fx_listings" for c in _VAR_COLS)))
def q_variance(spark, sf_dir):
    return rounded(E.variance_filter(fixture(spark, sf_dir, "fx_listings"), _VAR_COLS), 4)


_HC_COLS = ["price", "kilometers", "power", "cylinder", "trunk"]


@register("e06_high_correlation_pairs", with_fixture("fx_listings", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM fx_listings) "
    f"WHERE abs(corr) > 0.5" for i, a in enumerate(_HC_COLS) for b in _HC_COLS[i + 1:])))
def q_high_corr(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return rounded(E.high_correlation_pairs(fx, _HC_COLS, 0.5), 6)


_KEEP_COLS = ["age", "year", "price", "power"]


@register("e06_keep_list", with_fixture("fx_listings", f"""
, r AS (SELECT {", ".join(f"abs(corr({a}, {b})) > 0.8 AS {a}_{b}" for i, a in enumerate(_KEEP_COLS) for b in _KEEP_COLS[i + 1:])} FROM fx_listings),
k2 AS (SELECT *, NOT age_year AS k_year FROM r), k3 AS (SELECT *, NOT age_price AND NOT (k_year AND year_price) AS k_price FROM k2),
k4 AS (SELECT *, NOT age_power AND NOT (k_year AND year_power) AND NOT (k_price AND price_power) AS k_power FROM k3)
SELECT c AS "column" FROM (SELECT unnest(list_filter(['age', CASE WHEN k_year THEN 'year' END, CASE WHEN k_price THEN 'price' END,
       CASE WHEN k_power THEN 'power' END], lambda x: x IS NOT NULL)) AS c FROM k4)"""))
def q_keep_list(spark, sf_dir):
    """Columns left by greedy pruning of strong correlations."""
    fx = fixture(spark, sf_dir, "fx_listings")
    return spark.createDataFrame([(c,) for c in E.high_correlation_filter(fx, _KEEP_COLS, 0.8)], "column string")


_TA_NUM = ["kilometers", "trunk", "cylinder", "power", "age"]
_TA_CAT = ["condition", "design", "wheel_drive"]


@register("e07_select_by_association", with_fixture("fx_listings", """
, g AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(price) AS n, avg(price) AS m FROM fx_listings WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in _TA_CAT) + """),
t AS (SELECT count(*) AS nn, avg(price) AS mean, var_samp(price) AS v FROM fx_listings),
h AS (SELECT feature, sqrt(sum(n * pow(m - t.mean, 2)) / max(t.nn) / max(t.v)) AS a FROM g, t GROUP BY feature),
allf AS (SELECT feature, 'categorical' AS kind, a AS association FROM h UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', 'numeric', corr(price, {c}) FROM fx_listings" for c in _TA_NUM) + """)
SELECT feature, kind, round(association, 6) AS association FROM allf WHERE abs(association) >= 0.1"""))
def q_select_assoc(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    assoc = P.target_association(fx, "price", _TA_NUM, _TA_CAT)
    return rounded(E.select_by_association(assoc, 0.1), 6)


@register("e09_features_label", with_fixture("fx_listings", """
SELECT price AS label, CAST(age AS DOUBLE) AS f0, CAST(kilometers AS DOUBLE) AS f1, CAST(power AS DOUBLE) AS f2 FROM fx_listings"""))
def q_features_label(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    fx = fixture(spark, sf_dir, "fx_listings")
    v = vector_to_array("features")
    made = E.features_label(fx, "price", ["age", "kilometers", "power"])
    return made.select("label", *[F.nanvl(v[i], F.lit(None).cast("double")).alias(f"f{i}") for i in range(3)])


@register("e10_train_test_split", with_fixture("fx_listings", f"""
SELECT id, CASE WHEN {SHARE_SQL.format(k='id')} < 0.8 THEN 'train' ELSE 'test' END AS role FROM fx_listings"""))
def q_split(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id")
    return E.train_test_split(fx, "id", 0.8, seed=42)


@register("e11_standardize", with_fixture("fx_listings", """
, s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(kilometers) AS mk, stddev_pop(kilometers) AS sk,
               avg(age) AS ma, stddev_pop(age) AS sa FROM fx_listings)
SELECT id, round((price - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 6) AS price,
       round((kilometers - mk) / CASE WHEN sk = 0 THEN 1 ELSE sk END, 6) AS kilometers,
       round((age - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) AS age
FROM fx_listings, s"""))
def q_standardize(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "price", "kilometers", "age")
    return rounded(E.standardize(fx, ["price", "kilometers", "age"]), 6)


@register("e12_min_max_scale", with_fixture("fx_listings", f"""
, r AS (SELECT *, CASE WHEN {SHARE_SQL.format(k='id')} < 0.8 THEN 'train' ELSE 'test' END AS role FROM fx_listings),
f AS (SELECT min(price) AS lp, max(price) AS hp, min(kilometers) AS lk, max(kilometers) AS hk,
             min(age) AS la, max(age) AS ha FROM r WHERE role = 'train')
SELECT id, role, round((price - lp) / CASE WHEN hp - lp = 0 THEN 1 ELSE hp - lp END, 6) AS price,
       round((kilometers - lk) / CASE WHEN hk - lk = 0 THEN 1 ELSE hk - lk END, 6) AS kilometers,
       round((age - la) / CASE WHEN ha - la = 0 THEN 1 ELSE ha - la END, 6) AS age
FROM r, f"""))
def q_minmax(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "price", "kilometers", "age")
    split = E.train_test_split(fx, "id", 0.8, seed=42)
    cols = ["price", "kilometers", "age"]
    fitted = E.fit_min_max(split.where(F.col("role") == "train"), cols)
    return rounded(E.apply_min_max(split, fitted, cols), 6).select("id", "role", *cols)
