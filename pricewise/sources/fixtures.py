"""Fixture frames derived from the driver tables.

Each fixture is one SQL text that runs unchanged in Spark SQL (over temp
views registered by ``register_tables``) and in DuckDB (over the
pre-registered views), so a Spark operator applied to the fixture can be
checked against hand-written SQL over the very same rows.  Every fixture reads
whole tables; missing values come from the data itself (orders without
lines, negative balances, absent attributes), never from id subsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewise.operators.score import VOCABULARY
from pricewise.sources.tables import register_tables

NBSP = "chr(160)"

# Listings: one row per order, car-like attributes mapped from the order,
# its customer, nation and line items.  ``kilometers``/``cylinder``/``power``
# are NULL for orders without line items, ``trunk`` for negative balances.
FX_LISTINGS = """
SELECT o.o_orderkey AS id,
       o.o_totalprice AS price,
       n.n_name AS brand,
       o.o_orderpriority AS condition,
       c.c_mktsegment AS design,
       CAST(year(o.o_orderdate) AS INTEGER) AS year,
       CAST(2026 - year(o.o_orderdate) AS INTEGER) AS age,
       l.km AS kilometers,
       CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS trunk,
       l.disc AS cylinder,
       l.power AS power,
       CASE WHEN c.c_mktsegment = 'MACHINERY' AND o.o_orderstatus = 'P' THEN NULL
            ELSE o.o_orderstatus END AS wheel_drive
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey,
                  sum(l_quantity) AS km,
                  round(avg(l_discount), 6) AS disc,
                  round(sum(l_extendedprice) / 1000.0, 3) AS power
           FROM lineitem GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
"""

# Raw scraped listings: dirty strings rebuilt from known part attributes so
# that the clean value of every field is known.  U+00A0 separates digit
# groups as on the scraped pages.
FX_RAW = f"""
SELECT p_partkey AS id,
       concat(upper(p_brand), ' ', p_name) AS title,
       concat(CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR(20)), {NBSP},
              lpad(CAST(CAST(round((p_retailprice - floor(p_retailprice)) * 1000) AS BIGINT) AS VARCHAR(20)), 3, '0'),
              ' Ft') AS price_raw,
       CASE WHEN p_size % 5 = 0 THEN concat(CAST(500000 + p_partkey AS VARCHAR(20)), ' Ft') END AS discount_raw,
       concat(CAST(1980 + p_size % 40 AS VARCHAR(10)),
              CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN ' 30 old' ELSE '/8' END) AS year_raw,
       concat(CAST(p_size AS VARCHAR(10)), {NBSP}, '000 km') AS km_raw,
       concat(CAST(2 + p_size % 6 AS VARCHAR(10)), ' fő') AS persons_raw,
       CASE WHEN p_type = 'LARGE' THEN NULL
            ELSE concat('1', {NBSP}, lpad(CAST(p_size * 7 AS VARCHAR(10)), 3, '0'), ' kg') END AS weight_raw,
       CASE WHEN p_type = 'MEDIUM' THEN NULL
            ELSE concat(CAST(200 + p_size * 3 AS VARCHAR(10)), ' liter') END AS trunk_raw,
       concat('1', {NBSP}, lpad(CAST(p_size * 10 AS VARCHAR(10)), 3, '0'), ' cm³') AS cylinder_raw,
       CASE WHEN p_type = 'PROMO' THEN NULL
            ELSE concat(CAST(40 + p_size AS VARCHAR(10)), ' kW, ', CAST(60 + p_size AS VARCHAR(10)), ' LE') END AS power_raw,
       CASE WHEN p_type = 'SMALL' THEN NULL
            ELSE concat(CAST(2020 + p_size % 8 AS VARCHAR(10)), '/', CAST(1 + p_size % 12 AS VARCHAR(10))) END AS inspection_raw,
       CASE p_size % 5 WHEN 0 THEN 'Benzin/Gáz' WHEN 1 THEN 'Hibrid (Benzin)'
                       WHEN 2 THEN 'Elektromos' WHEN 3 THEN 'Dízel' END AS fuel,
       CASE p_type WHEN 'STANDARD' THEN 'Manuális (6 fokozatú)' WHEN 'ECONOMY' THEN 'Automata (7 fokozatú)'
                   WHEN 'MEDIUM' THEN 'Tiptronic' WHEN 'PROMO' THEN 'Szekvenciális'
                   WHEN 'LARGE' THEN 'Manuális (5 fokozatú)' END AS gearbox,
       CASE p_size % 4 WHEN 0 THEN 'Digitális kétzónás' WHEN 1 THEN 'Automata'
                       WHEN 2 THEN 'Manuális' WHEN 3 THEN 'Hőszivattyús klíma' END AS aircon
FROM part
"""

# Scraped rows with repeats: one listing per line item, attributes of the
# part it sells.  Parts sold many times repeat as exact duplicate rows.
FX_REPEATS = """
SELECT concat(upper(p.p_brand), ' ', p.p_name) AS title,
       p.p_type AS design,
       p.p_size AS size,
       l.l_returnflag AS flag,
       CASE WHEN l.l_linestatus = 'F' THEN NULL ELSE p.p_retailprice END AS price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

# Daily series: one row per order priority and order day.
FX_DAILY = """
SELECT o_orderpriority AS series,
       CAST(o_orderdate AS DATE) AS d,
       avg(o_totalprice) AS open,
       max(o_totalprice) AS high,
       min(o_totalprice) AS low,
       max(o_totalprice) / min(o_totalprice) AS spread
FROM orders
GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)
"""

# Residual frame: actual event value vs the mean of its event type.
FX_RESIDUALS = """
SELECT e.event_id AS i,
       e.value AS actual,
       g.m AS predicted
FROM events e
JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) g
  ON e.event_type = g.event_type
"""

# Key/value detail pages: every part wrapped into an attribute table like the
# scraped detail pages (key cell, value in <strong>).
FX_KV_PAGES = """
SELECT p_partkey AS page_id,
       concat('<html><body><h3><a href="/p/', CAST(p_partkey AS VARCHAR(20)), '">', upper(p_brand), ' ', p_name,
              '</a></h3><table class="hirdetesadatok">',
              '<tr><td class="bal pontos"> Kivitel: </td><td><strong> ', p_type, ' </strong></td></tr>',
              '<tr><td class="bal pontos">Méret:</td><td><strong>', CAST(p_size AS VARCHAR(10)), '</strong></td></tr>',
              '<tr><td class="bal pontos">Vételár:</td><td><strong>', CAST(p_retailprice AS VARCHAR(30)), ' Ft</strong></td></tr>',
              CASE WHEN p_size > 25 THEN concat('<tr><td class="bal pontos">Kivitel:</td><td><strong>',
                                               p_name, '</strong></td></tr>') ELSE '' END,
              '</table></body></html>') AS html
FROM part
"""

# Scoring requests: parts mapped onto the form vocabularies by
# position in a space-separated level list; each list ends with the
# baseline level and one value outside the vocabulary, so fall-through and
# reject rules are exercised on every scale.
_UNKNOWN = {"brand": "lada", "year": "2021", "condition": "roncs", "design": "pickup", "aircon": "nincs", "fuel": "gaz", "gearbox": "cvt"}
_LEVELS = {field: " ".join([*levels, baseline, _UNKNOWN[field]]) for field, levels, baseline, _ in VOCABULARY}


def _pick(field: str, driver: str) -> str:
    n = len(_LEVELS[field].split())
    return f"split_part('{_LEVELS[field]}', ' ', CAST(({driver}) % {n} + 1 AS INTEGER)) AS {field}"


FX_REQUESTS = f"""
SELECT p_partkey AS id,
       CAST(p_size * 5000 + p_partkey % 1000 AS INTEGER) AS km,
       round(p_retailprice / 4, 1) AS trunk,
       CAST(900 + p_size * 30 AS INTEGER) AS cylinder,
       CAST(40 + p_size * 2 AS INTEGER) AS power,
       CAST(round((40 + p_size * 2) * 1.36) AS INTEGER) AS hp,
       {_pick("brand", "p_partkey")},
       {_pick("year", "p_size")},
       {_pick("condition", "p_partkey + p_size")},
       {_pick("design", "p_partkey")},
       {_pick("aircon", "p_size + 1")},
       {_pick("fuel", "p_partkey + 2")},
       {_pick("gearbox", "p_size + 3")},
       p_retailprice * 1000 AS price
FROM part
"""

FIXTURES = {
    "fx_listings": FX_LISTINGS,
    "fx_raw": FX_RAW,
    "fx_repeats": FX_REPEATS,
    "fx_daily": FX_DAILY,
    "fx_residuals": FX_RESIDUALS,
    "fx_kv_pages": FX_KV_PAGES,
    "fx_requests": FX_REQUESTS,
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture frame in Spark from the tables under ``sf_dir``."""
    register_tables(spark, sf_dir)
    return spark.sql(FIXTURES[name])


def with_fixture(name: str, body: str) -> str:
    """DuckDB/ANSI text: ``WITH <name> AS (<fixture>) <body>``."""
    return f"WITH {name} AS ({FIXTURES[name]}) {body}"


def with_fixtures(names: list[str], body: str) -> str:
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    return f"WITH {ctes} {body}"
