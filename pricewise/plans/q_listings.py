"""Checked queries for cleaning (B) and profiling (D) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewise.functions.text import (AIRCON_RULES, FUEL_RULES, GEARBOX_RULES, safe_ratio)
from pricewise.operators import columns as C
from pricewise.operators import profile as P
from pricewise.operators.features import filter_upper_fence
from pricewise.plans.listings import (clean_raw_listings, flagship, generalize_categories)
from pricewise.plans.registry import register, rounded
from pricewise.sources.fixtures import fixture, with_fixture

NUM = ["price", "kilometers", "trunk", "cylinder", "power", "age"]
CAT = ["brand", "condition", "design", "wheel_drive"]


# ------------------------------------------------------------- SQL helpers
def _sql_parse(expr: str, n: int, cast: str = "DOUBLE", strip_first: bool = True) -> str:
    if strip_first:
        s = f"replace({expr}, chr(160), '')"
        s = f"substr({s}, 1, greatest(length({s}) - {n}, 0))"
    else:
        s = f"replace(substr({expr}, 1, greatest(length({expr}) - {n}, 0)), chr(160), '')"
    return f"CAST(trim({s}) AS {cast})"


def _sql_recode(col: str, rules) -> str:
    whens = " ".join(f"WHEN strpos(lower({col}), '{p}') > 0 THEN '{t}'" for p, t in reversed(rules))
    return f"CASE {whens} ELSE {col} END"


_YEAR = "trim(split_part(trim(split_part(year_raw, '/', 1)), ' ', 1))"
SQL_CLEAN = f"""
SELECT id,
  {_sql_parse("coalesce(discount_raw, price_raw)", 2, "BIGINT")} AS price,
  split_part(title, ' ', 1) AS brand,
  {_YEAR} AS year,
  CAST(2026 - CAST({_YEAR} AS INTEGER) AS INTEGER) AS age,
  {_sql_parse("km_raw", 2, "BIGINT")} AS kilometers,
  trim(substr(persons_raw, 1, greatest(length(persons_raw) - 2, 0))) AS persons,
  {_sql_parse("weight_raw", 2)} AS own_weight,
  {_sql_parse("trunk_raw", 5, strip_first=False)} AS trunk,
  CAST(split_part(replace(cylinder_raw, chr(160), ''), ' ', 1) AS DOUBLE) AS cylinder,
  {_sql_parse("split_part(power_raw, ',', 1)", 2)} AS power_kw,
  {_sql_parse("split_part(power_raw, ',', 2)", 2)} AS power_hp,
  split_part(inspection_raw, '/', 1) AS roadworthiness,
  fuel, gearbox, aircon,
  {_sql_recode("fuel", FUEL_RULES)} AS fuel_generalized,
  {_sql_recode("gearbox", GEARBOX_RULES)} AS gearbox_generalized,
  {_sql_recode("aircon", AIRCON_RULES)} AS aircon_generalized
FROM fx_raw
"""


def _stack_sql(src: str, cols, cast: str = "DOUBLE", extra: str = "") -> str:
    extra_sel = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {extra_sel}'{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {src}" for c in cols)


# ------------------------------------------------------------- flagship
def q_flagship(spark, sf_dir):
    return rounded(flagship(fixture(spark, sf_dir, "fx_raw")), 6)


register("flagship_fuel_profile", with_fixture("fx_raw", f"""
SELECT fuel_generalized, CAST(count(*) AS BIGINT) AS listings,
  round(avg(price), 6) AS mean_price, round(avg(kilometers), 6) AS mean_km,
  round(avg(age), 6) AS mean_age, round(avg(power_kw), 6) AS mean_power_kw,
  round(avg(CASE WHEN age = 0 THEN kilometers ELSE kilometers / age END), 6) AS mean_km_per_year
FROM ({SQL_CLEAN}) c WHERE fuel_generalized IS NOT NULL GROUP BY fuel_generalized
"""))(q_flagship)


# ------------------------------------------------------------- B: cleaning
@register("b06_b11_clean_listings", with_fixture("fx_raw", f"""
SELECT id, price, brand, year, age, kilometers, persons, own_weight, trunk, cylinder,
       power_kw, power_hp, roadworthiness, fuel, gearbox, aircon FROM ({SQL_CLEAN}) c"""))
def q_clean(spark, sf_dir):
    return clean_raw_listings(fixture(spark, sf_dir, "fx_raw"))


@register("b10_literal_null_text_compat", with_fixture("fx_raw", """
SELECT id, coalesce(split_part(inspection_raw, '/', 1), 'nan') AS roadworthiness FROM fx_raw"""))
def q_nan_text(spark, sf_dir):
    return clean_raw_listings(fixture(spark, sf_dir, "fx_raw"), compat=True).select("id", "roadworthiness")


@register("b12_recode_by_substring", with_fixture("fx_raw", f"""
SELECT id, fuel_generalized, gearbox_generalized, aircon_generalized FROM ({SQL_CLEAN}) c"""))
def q_recode(spark, sf_dir):
    raw = fixture(spark, sf_dir, "fx_raw")
    return generalize_categories(raw).select("id", "fuel_generalized", "gearbox_generalized",
                                             "aircon_generalized")


@register("b13_safe_ratio", with_fixture("fx_listings", """
SELECT id, round(CASE WHEN year - 1995 = 0 THEN power ELSE power / (year - 1995) END, 6) AS power_per_year
FROM fx_listings"""))
def q_safe_ratio(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return rounded(fx.select("id", safe_ratio("power", F.col("year") - 1995).alias("power_per_year")), 6)


@register("b01_drop_columns", with_fixture("fx_listings", """
SELECT id, price, brand, condition, design, year, age, kilometers, power, wheel_drive FROM fx_listings"""))
def q_drop(spark, sf_dir):
    return C.drop_columns(fixture(spark, sf_dir, "fx_listings"), ["trunk", "cylinder"])


@register("b02_keep_columns", with_fixture("fx_listings", """
SELECT price, brand, kilometers, age FROM fx_listings"""))
def q_keep(spark, sf_dir):
    return C.keep_columns(fixture(spark, sf_dir, "fx_listings"), include=["price", "brand", "kilometers", "age"])


@register("b03_select_numeric", with_fixture("fx_listings", """
SELECT price, year, age, kilometers, trunk, cylinder, power FROM fx_listings"""))
def q_select_numeric(spark, sf_dir):
    return C.select_by_type(fixture(spark, sf_dir, "fx_listings"), "numeric", skip_first=True)


@register("b04_reorder_columns", with_fixture("fx_listings", """
SELECT price, kilometers, id, brand, condition, design, year, age, trunk, cylinder, power, wheel_drive
FROM fx_listings"""))
def q_reorder(spark, sf_dir):
    return C.reorder_columns(fixture(spark, sf_dir, "fx_listings"), ["price", "kilometers"])


@register("b05_rename_columns", with_fixture("fx_listings", """
SELECT id, price AS "Price (HUF)", brand AS "Brand", kilometers AS "Kilometers" FROM fx_listings"""))
def q_rename(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "price", "brand", "kilometers")
    return C.rename_columns(fx, {"price": "Price (HUF)", "brand": "Brand", "kilometers": "Kilometers"})


@register("b14_filter_upper_fence", with_fixture("fx_listings", """
SELECT id, kilometers FROM fx_listings,
  (SELECT quantile_cont(kilometers, 0.25) AS q1, quantile_cont(kilometers, 0.75) AS q3 FROM fx_listings) q
WHERE NOT coalesce(kilometers > q3 + 1.5 * (q3 - q1), false)"""))
def q_fence(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select("id", "kilometers")
    return filter_upper_fence(fx, "kilometers", 1.5)


@register("b15_fill_nulls_where", with_fixture("fx_listings", """
SELECT f.id, round(coalesce(f.trunk, g.m), 6) AS trunk FROM fx_listings f
JOIN (SELECT design, avg(trunk) AS m FROM fx_listings GROUP BY design) g ON f.design = g.design"""))
def q_fill(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    pred = fx.groupBy("design").agg(F.avg("trunk").alias("pred"))
    out = C.fill_nulls_where(fx.join(pred, "design"), "trunk", "pred")
    return rounded(out.select("id", "trunk"), 6)


@register("b16_row_subset", with_fixture("fx_listings", """
SELECT id, price, brand FROM fx_listings WHERE brand = 'GERMANY' AND kilometers IS NULL"""))
def q_subset(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return C.row_subset(fx, (F.col("brand") == "GERMANY") & F.col("kilometers").isNull()) \
        .select("id", "price", "brand")


@register("b17_head_top_prices", with_fixture("fx_listings", """
SELECT id, price FROM fx_listings ORDER BY price DESC, id LIMIT 10"""))
def q_head(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return C.head(fx, 10, [F.desc("price"), F.asc("id")]).select("id", "price")


@register("b17_row_at", with_fixture("fx_listings", """
SELECT price FROM fx_listings ORDER BY price, id LIMIT 1 OFFSET 99"""))
def q_row_at(spark, sf_dir):
    return C.row_at(fixture(spark, sf_dir, "fx_listings"), ["price", "id"], 99, "price")


# ------------------------------------------------------------- D: profiles
@register("d01_find_duplicates", with_fixture("fx_repeats", """
SELECT r.* FROM fx_repeats r JOIN (
  SELECT title, design, size, flag, price FROM fx_repeats GROUP BY ALL HAVING count(*) > 1) d
ON r.title IS NOT DISTINCT FROM d.title AND r.design IS NOT DISTINCT FROM d.design
 AND r.size IS NOT DISTINCT FROM d.size AND r.flag IS NOT DISTINCT FROM d.flag
 AND r.price IS NOT DISTINCT FROM d.price"""))
def q_find_dups(spark, sf_dir):
    return P.find_duplicates(fixture(spark, sf_dir, "fx_repeats"))


@register("d02_drop_duplicates", with_fixture("fx_repeats", "SELECT DISTINCT * FROM fx_repeats"))
def q_drop_dups(spark, sf_dir):
    return P.drop_duplicates(fixture(spark, sf_dir, "fx_repeats"))


_TYPES = [("id", "bigint"), ("price", "double"), ("brand", "string"), ("condition", "string"),
          ("design", "string"), ("year", "int"), ("age", "int"), ("kilometers", "double"),
          ("trunk", "double"), ("cylinder", "double"), ("power", "double"), ("wheel_drive", "string")]


@register("d03_schema_profile", with_fixture("fx_listings", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS dtype, "
    f"CAST(count({c}) AS BIGINT) AS non_null FROM fx_listings" for i, (c, t) in enumerate(_TYPES)) + ") s"))
def q_schema(spark, sf_dir):
    return P.schema_profile(fixture(spark, sf_dir, "fx_listings"))


def _describe_sql(by: str | None) -> str:
    cols = NUM
    b = f"{by}, " if by else ""
    where = f"WHERE {by} IS NOT NULL" if by else ""
    long = _stack_sql("fx_listings", cols, extra=by or "")
    return with_fixture("fx_listings", f"""
SELECT {b}"column", CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM ({long}) l {where} GROUP BY {b}"column" """)


@register("d04_describe", _describe_sql(None))
def q_describe(spark, sf_dir):
    return rounded(P.describe(fixture(spark, sf_dir, "fx_listings"), NUM), 6)


@register("d05_describe_by_brand", _describe_sql("brand"))
def q_describe_by(spark, sf_dir):
    return rounded(P.describe_by(fixture(spark, sf_dir, "fx_listings"), ["brand"], NUM), 6)


@register("d06_distinct_sorted", with_fixture("fx_listings",
                                               "SELECT DISTINCT brand FROM fx_listings WHERE brand IS NOT NULL"))
def q_distinct(spark, sf_dir):
    return P.distinct_sorted(fixture(spark, sf_dir, "fx_listings"), "brand")


@register("d07_value_counts", with_fixture("fx_listings", f"""
SELECT "column", value, CAST(count(*) AS BIGINT) AS count
FROM ({_stack_sql("fx_listings", CAT, "VARCHAR")}) l WHERE value IS NOT NULL GROUP BY "column", value"""))
def q_value_counts(spark, sf_dir):
    return P.value_counts(fixture(spark, sf_dir, "fx_listings"), CAT)


_BOX_COLS = ["price", "kilometers", "power"]


@register("d08_box_stats_by_condition", with_fixture("fx_listings", f"""
, l AS (SELECT * FROM ({_stack_sql("fx_listings", _BOX_COLS, extra="condition")}) s
        WHERE value IS NOT NULL AND condition IS NOT NULL),
q AS (SELECT condition, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM l GROUP BY condition, "column")
SELECT l.condition, l."column", round(q.q1, 6) AS q1, round(q.med, 6) AS median, round(q.q3, 6) AS q3,
  round(q.q3 - q.q1, 6) AS iqr,
  round(min(CASE WHEN value >= q.q1 - 1.5 * (q.q3 - q.q1) THEN value END), 6) AS whisker_low,
  round(max(CASE WHEN value <= q.q3 + 1.5 * (q.q3 - q.q1) THEN value END), 6) AS whisker_high,
  CAST(count(CASE WHEN value < q.q1 - 1.5 * (q.q3 - q.q1) OR value > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 END) AS BIGINT)
    AS n_outliers
FROM l JOIN q ON l.condition = q.condition AND l."column" = q."column"
GROUP BY l.condition, l."column", q.q1, q.med, q.q3"""))
def q_box(spark, sf_dir):
    return rounded(P.box_stats(fixture(spark, sf_dir, "fx_listings"), _BOX_COLS, ["condition"]), 6)


@register("d09_histogram_by_design", with_fixture("fx_listings", """
, base AS (SELECT design, price AS x FROM fx_listings WHERE price IS NOT NULL AND design IS NOT NULL),
rng AS (SELECT design, min(x) AS mn, max(x) AS mx, (max(x) - min(x)) / 10 AS w FROM base GROUP BY design),
grid AS (SELECT design, CAST(b AS INTEGER) AS bin, mn + CAST(b AS INTEGER) * w AS lo,
                mn + (CAST(b AS INTEGER) + 1) * w AS hi FROM rng, range(0, 10) t(b)),
cnt AS (SELECT b.design, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - mn) / w), 9) END AS INTEGER) AS bin,
               count(*) AS c FROM base b JOIN rng r ON b.design = r.design GROUP BY 1, 2)
SELECT g.design, g.bin, round(g.lo, 6) AS lo, round(g.hi, 6) AS hi, CAST(coalesce(c, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt ON g.design = cnt.design AND g.bin = cnt.bin"""))
def q_hist(spark, sf_dir):
    return rounded(P.histogram(fixture(spark, sf_dir, "fx_listings"), "price", 10, ["design"]), 6)


@register("d10_binned_pairs", with_fixture("fx_listings", """
, base AS (SELECT CAST(price AS DOUBLE) AS x, CAST(kilometers AS DOUBLE) AS y FROM fx_listings
           WHERE price IS NOT NULL AND kilometers IS NOT NULL),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM base)
SELECT CAST(CASE WHEN (x1 - x0) / 10 = 0 THEN 0 ELSE least(floor((x - x0) / ((x1 - x0) / 10)), 9) END AS INTEGER) AS bx,
       CAST(CASE WHEN (y1 - y0) / 8 = 0 THEN 0 ELSE least(floor((y - y0) / ((y1 - y0) / 8)), 7) END AS INTEGER) AS "by",
       CAST(count(*) AS BIGINT) AS count
FROM base, r GROUP BY 1, 2"""))
def q_binned(spark, sf_dir):
    return P.binned_pairs(fixture(spark, sf_dir, "fx_listings"), "price", "kilometers", 10, 8)


@register("d11_group_density", with_fixture("fx_listings", """
, base AS (SELECT condition AS level, CAST(price AS DOUBLE) AS x FROM fx_listings
           WHERE condition IS NOT NULL AND price IS NOT NULL),
st AS (SELECT level, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM base GROUP BY level),
st2 AS (SELECT *, sd * pow(n, -0.2) AS h FROM st),
st3 AS (SELECT *, mn - 2.0 * h AS g0, (mx - mn + 4.0 * h) / 19 AS gs FROM st2 WHERE h > 0)
SELECT b.level, CAST(gi AS INTEGER) AS gi, round(s.g0 + CAST(gi AS INTEGER) * s.gs, 4) AS x,
  round(sum(exp(-pow((s.g0 + CAST(gi AS INTEGER) * s.gs) - b.x, 2) / (2 * pow(s.h, 2))))
        / (s.n * s.h * sqrt(2 * pi())), 14) AS density
FROM base b JOIN st3 s ON b.level = s.level, range(0, 20) t(gi)
GROUP BY b.level, gi, s.g0, s.gs, s.n, s.h"""))
def q_density(spark, sf_dir):
    d = P.group_density(fixture(spark, sf_dir, "fx_listings"), "price", "condition", grid=20)
    return rounded(d, {"x": 4, "density": 14})


@register("d12_pivot_mean", with_fixture("fx_listings", """
SELECT brand, condition, year, round(avg(price), 6) AS price, round(avg(kilometers), 6) AS kilometers,
       round(avg(age), 6) AS age
FROM fx_listings WHERE brand IS NOT NULL AND condition IS NOT NULL AND year IS NOT NULL
GROUP BY brand, condition, year"""))
def q_pivot(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return rounded(P.pivot_mean(fx, ["brand", "condition", "year"], ["price", "kilometers", "age"], "brand"), 6)


@register("d13_mean_by_each", with_fixture("fx_listings", " UNION ALL ".join(
    f"SELECT '{k}' AS key, CAST({k} AS VARCHAR) AS level, round(avg(price), 6) AS mean FROM fx_listings "
    f"WHERE {k} IS NOT NULL GROUP BY {k}" for k in ["design", "wheel_drive", "condition"])))
def q_mean_each(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return rounded(P.mean_by_each(fx, ["design", "wheel_drive", "condition"], "price"), 6)


def _corr_sql() -> str:
    parts = []
    for a in NUM:
        for b in NUM:
            if a == b:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, 1.0 AS corr")
            else:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM fx_listings")
    return with_fixture("fx_listings", " UNION ALL ".join(parts))


@register("d14_correlation_matrix", _corr_sql())
def q_corr(spark, sf_dir):
    return rounded(P.correlation_matrix(fixture(spark, sf_dir, "fx_listings"), NUM), 6)


@register("d15_crosstab", with_fixture("fx_listings", """
, c AS (SELECT condition AS a, wheel_drive AS b, count(*) AS n FROM fx_listings
        WHERE condition IS NOT NULL AND wheel_drive IS NOT NULL GROUP BY 1, 2)
SELECT la.a, lb.b, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT DISTINCT a FROM c) la CROSS JOIN (SELECT DISTINCT b FROM c) lb
LEFT JOIN c ON c.a = la.a AND c.b = lb.b"""))
def q_crosstab(spark, sf_dir):
    return P.crosstab(fixture(spark, sf_dir, "fx_listings"), "condition", "wheel_drive", ["F", "O", "P"])


def _chi2_sql(pairs, src: str = "fx_listings") -> str:
    """Independent oracle: sum over the complete R x C grid (zero cells
    included) of (O-E)^2/E, Yates-corrected when the table is 2 x 2."""
    cells = " UNION ALL ".join(
        f"SELECT '{x}' AS var1, '{y}' AS var2, CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b "
        f"FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in pairs)
    return f"""
cells AS ({cells}),
obs AS (SELECT var1, var2, a, b, count(*) AS o FROM cells GROUP BY ALL),
ra AS (SELECT var1, var2, a, sum(o) AS ra FROM obs GROUP BY ALL),
cb AS (SELECT var1, var2, b, sum(o) AS cb FROM obs GROUP BY ALL),
dims AS (SELECT var1, var2, sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM obs GROUP BY ALL),
grid AS (SELECT ra.var1, ra.var2, ra.a, cb.b, ra.ra, cb.cb FROM ra JOIN cb ON ra.var1 = cb.var1 AND ra.var2 = cb.var2),
terms AS (SELECT g.var1, g.var2, coalesce(o.o, 0) AS o, g.ra * g.cb / d.n AS e, d.r, d.c
          FROM grid g JOIN dims d ON g.var1 = d.var1 AND g.var2 = d.var2
          LEFT JOIN obs o ON o.var1 = g.var1 AND o.var2 = g.var2 AND o.a = g.a AND o.b = g.b),
chi AS (SELECT var1, var2, r, c,
          CASE WHEN (r - 1) * (c - 1) = 0 THEN 0.0
               WHEN (r - 1) * (c - 1) = 1 THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e)
               ELSE sum(pow(o - e, 2) / e) END AS chi2
        FROM terms GROUP BY var1, var2, r, c)"""


@register("d16_chi2_stat", with_fixture("fx_listings", ", " + _chi2_sql([("condition", "wheel_drive")]) + """
SELECT round(chi2, 6) AS chi2, CAST((r - 1) * (c - 1) AS BIGINT) AS dof FROM chi"""))
def q_chi2(spark, sf_dir):
    return rounded(P.chi2_stat(fixture(spark, sf_dir, "fx_listings"), "condition", "wheel_drive")
                   .select("chi2", "dof"), 6)


_YATES_SRC = ("(SELECT CASE WHEN price > 200000 THEN 'high' ELSE 'low' END AS band, "
              "CASE WHEN design = 'BUILDING' THEN 'Y' ELSE 'N' END AS building FROM fx_listings) s")


@register("d16_chi2_yates_2x2", with_fixture("fx_listings", ", " + _chi2_sql([("band", "building")], _YATES_SRC) + """
SELECT round(chi2, 6) AS chi2, CAST((r - 1) * (c - 1) AS BIGINT) AS dof FROM chi"""))
def q_chi2_yates(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings").select(
        F.when(F.col("price") > 200000, "high").otherwise("low").alias("band"),
        F.when(F.col("design") == "BUILDING", "Y").otherwise("N").alias("building"))
    return rounded(P.chi2_stat(fx, "band", "building").select("chi2", "dof"), 6)


@register("d16_chi2_pvalue", with_fixture("fx_listings", ", " + _chi2_sql([("condition", "wheel_drive")]) + """
SELECT round(chi2, 6) AS chi2, CAST((r - 1) * (c - 1) AS BIGINT) AS dof,
       round(list_sum(list_transform(range(0, CAST((r - 1) * (c - 1) / 2 AS BIGINT)),
             lambda i: exp(-chi2 / 2) * pow(chi2 / 2, i) / gamma(i + 1.0))), 9) AS p FROM chi"""))
def q_chi2_p(spark, sf_dir):
    """An even number of degrees of freedom has a closed tail."""
    return rounded(P.chi2_stat(fixture(spark, sf_dir, "fx_listings"), "condition", "wheel_drive"), {"chi2": 6, "p": 9})


@register("d17_cramers_matrix", with_fixture("fx_listings", ", " + _chi2_sql([(x, y) for x in CAT for y in CAT]) + """
SELECT var1, var2, round(CASE WHEN least(r, c) - 1 > 0
                              THEN sqrt(chi2 / ((SELECT count(*) FROM fx_listings) * (least(r, c) - 1))) END, 3)
       AS cramers_v FROM chi"""))
def q_cramers(spark, sf_dir):
    return P.cramers_matrix(fixture(spark, sf_dir, "fx_listings"), CAT, digits=3)


_H_CATS = ["condition", "design", "wheel_drive", "brand"]


def _h_sql(y: str, cats) -> str:
    per = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({y}) AS n, avg({y}) AS m, stddev_samp({y}) AS s FROM fx_listings "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cats)
    return f"""
, g AS ({per}),
t AS (SELECT count(*) AS nn, avg({y}) AS mean, var_samp({y}) AS v FROM fx_listings),
h AS (SELECT feature, sum(n * pow(m - t.mean, 2)) / max(t.nn) AS between_var,
             sum(n * pow(s, 2)) / max(t.nn) AS within_var, max(t.v) AS total_var
      FROM g, t GROUP BY feature)"""


@register("d18_correlation_ratio", with_fixture("fx_listings", _h_sql("price", _H_CATS) + """
SELECT feature, round(between_var, 2) AS between_var, round(within_var, 2) AS within_var,
       round(total_var, 2) AS total_var, round(sqrt(between_var / total_var), 6) AS H FROM h"""))
def q_h(spark, sf_dir):
    out = P.correlation_ratio(fixture(spark, sf_dir, "fx_listings"), "price", _H_CATS)
    return rounded(out, {"between_var": 2, "within_var": 2, "total_var": 2, "H": 6})


_TA_NUM = ["kilometers", "trunk", "cylinder", "power", "age"]
_TA_CAT = ["condition", "design", "wheel_drive"]


@register("d19_target_association", with_fixture("fx_listings", _h_sql("price", _TA_CAT) + " " + """
SELECT feature, 'categorical' AS kind, round(sqrt(between_var / total_var), 6) AS association FROM h
UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'numeric' AS kind, round(corr(price, {c}), 6) AS association FROM fx_listings"
    for c in _TA_NUM)))
def q_target_assoc(spark, sf_dir):
    out = P.target_association(fixture(spark, sf_dir, "fx_listings"), "price", _TA_NUM, _TA_CAT)
    return rounded(out, 6)


@register("d20_mode_values", with_fixture("fx_listings", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS mode, CAST(count(*) AS BIGINT) AS count "
    f"FROM fx_listings WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"
    for c in CAT)))
def q_modes(spark, sf_dir):
    return P.modes(fixture(spark, sf_dir, "fx_listings"), CAT)


@register("d21_best_row", with_fixture("fx_listings", """
SELECT brand, round(price, 6) AS price FROM (
  SELECT brand, avg(price) AS price FROM fx_listings WHERE brand IS NOT NULL GROUP BY brand)
ORDER BY price DESC, brand LIMIT 1"""))
def q_best(spark, sf_dir):
    fx = fixture(spark, sf_dir, "fx_listings")
    return rounded(P.best_row(P.pivot_mean(fx, ["brand"], ["price"]), "price"), 6)
