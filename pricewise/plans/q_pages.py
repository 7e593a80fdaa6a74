"""Checked queries for sources, sinks and page extraction."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pricewise.plans.registry import register
from pricewise.session import checkpoint_dir
from pricewise.sources import pages as PG
from pricewise.sources.fixtures import FIXTURES, fixture, with_fixture
from pricewise.sources.tables import load, read_table, register_tables, write_stage


# Class names of the detail table, and attribute names in it.
TABLE_CLASS, KEY_CLASS = "hirdetesadatok", "bal pontos"
ATTRIBUTES = ["Kivitel:", "Méret:", "Vételár:"]
# Character references the driver's flat pages hold; ``&amp;`` goes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


# ------------------------------------------------------------- SQL helpers
def _sql_text(expr: str) -> str:
    s = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for ent, ch in ENTITIES:
        ch_sql = ch.replace("'", "''")
        s = f"replace({s}, '{ent}', '{ch_sql}')"
    return f"regexp_replace({s}, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')"


def _sql_blocks(expr: str, tag: str, cls: str | None = None) -> str:
    open_tag = f"<{tag}(?:\\s[^>]*)?>" if cls is None else f'<{tag}\\s[^>]*class="{cls}"[^>]*>'
    return f"regexp_extract_all({expr}, '(?s){open_tag}(.*?)</{tag}>', 1)"


_ANCHOR = '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
_HAS_ANCHOR = '(?s)<a\\s[^>]*href="'
_TABLE = '(?s)<table\\s[^>]*class="[^"]*hirdetesadatok[^"]*"[^>]*>(.*?)</table>'

# Detail pages with a broken key column: small parts lose the key cell of
# their size row, leaving more values than keys (A7's second reason).
KV_SRC_SQL = """
SELECT 'part' AS src, page_id,
       CASE WHEN p.p_size < 3
            THEN replace(k.html, '<td class="bal pontos">Méret:</td>', '<td>Méret:</td>')
            ELSE k.html END AS html
FROM fx_kv_pages k JOIN part p ON p.p_partkey = k.page_id
UNION ALL
SELECT 'web' AS src, page_id, html FROM pages
"""


def _kv_src(spark, sf_dir):
    register_tables(spark, sf_dir, ["part", "pages"])
    fixture(spark, sf_dir, "fx_kv_pages").createOrReplaceTempView("fx_kv_pages")
    return spark.sql(KV_SRC_SQL)


def _sql_kv_pairs(src: str) -> str:
    """SQL for the exploded, last-wins key/value pairs of ``src``."""
    return f"""
t AS (SELECT src, page_id, html, regexp_extract(html, '{_TABLE}', 1) AS tb FROM {src}),
kv AS (SELECT src, page_id, html, {_sql_blocks('tb', 'td', 'bal pontos')} AS ks,
              {_sql_blocks('tb', 'strong')} AS vs FROM t),
ok AS (SELECT * FROM kv WHERE regexp_matches(html, '{_TABLE}') AND len(ks) >= len(vs)),
ex AS (SELECT src, page_id, ks, vs, unnest(generate_series(1, len(vs))) AS i FROM ok),
pr AS (SELECT src, page_id, i, {_sql_text('ks[i]')} AS attr, {_sql_text('vs[i]')} AS value FROM ex),
kept AS (SELECT * FROM pr p WHERE NOT EXISTS (
           SELECT 1 FROM pr q WHERE q.src = p.src AND q.page_id = p.page_id AND q.attr = p.attr AND q.i > p.i))
"""


# ------------------------------------------------------------- A1, A2
ORDERS_SCHEMA = "o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_totalprice DOUBLE, o_orderpriority STRING"


@register("a01_read_table", """
SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders""")
def q_read_table(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/orders.parquet", ORDERS_SCHEMA)


@register("a02_write_stage_round_trip", with_fixture("fx_daily", "SELECT * FROM fx_daily"))
def q_write_stage(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"stage-daily-{uuid.uuid4().hex}")
    return write_stage(fixture(spark, sf_dir, "fx_daily"), path, partition_by=["series"]) \
        .select("series", "d", "open", "high", "low", "spread")


# ------------------------------------------------------------- A3
@register("a03_page_requests", """
WITH t AS (SELECT page_id, concat(regexp_replace(url, '[?#].*$', ''), '?page={}') AS template FROM pages),
n AS (SELECT page_id, template, unnest(range(1, 252, 50)) AS page_no FROM t)
SELECT page_id, template, CAST((page_no - 1) // 50 AS INTEGER) AS page_pos, CAST(page_no AS INTEGER) AS page_no,
       replace(template, '{}', CAST(page_no AS VARCHAR)) AS url
FROM n""")
def q_page_requests(spark, sf_dir):
    templates = load(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?page={}")).alias("template"))
    return PG.page_requests(templates, start=1, stop=252, step=50)


# ------------------------------------------------------------- A4
@register("a04_extract_listing_links", f"""
WITH b AS (SELECT page_id, {_sql_blocks('html', 'li')} AS bl FROM pages),
e AS (SELECT page_id, unnest(bl) AS blk, unnest(generate_series(0, len(bl) - 1)) AS block_pos FROM b)
SELECT page_id, CAST(block_pos AS INTEGER) AS block_pos,
       CASE WHEN regexp_matches(blk, '{_HAS_ANCHOR}') THEN {_sql_text(f"regexp_extract(blk, '{_ANCHOR}', 2)")} END AS title,
       CASE WHEN regexp_matches(blk, '{_HAS_ANCHOR}') THEN regexp_extract(blk, '{_ANCHOR}', 1) END AS href,
       CASE WHEN NOT regexp_matches(blk, '{_HAS_ANCHOR}') THEN 'no anchor in block' END AS reject_reason
FROM e""")
def q_listing_links(spark, sf_dir):
    return PG.extract_listing_links(load(spark, sf_dir, "pages"), block_tag="li")


# Pages written from known values of ``part``: result blocks that nest their
# own tag, upper-case tags, single quotes and character references.
NESTED_SQL = """
SELECT p_partkey AS page_id, concat('<!-- ', p_name, ' --><DIV Class="hit row"><div class=pic><img src="x.png"></div>',
  '<div><H3><span>', p_type, '</span><a class=t href=''/p?a=1&amp;b=', p_partkey, '''>&nbsp;', p_name, '&nbsp;&eacute;&#x41;<br>',
  p_brand, ' </a></H3></div></DIV><div class="hit row"><div><h3>no link</h3></div><a href="/other">x</a></div>',
  '<div class="hit"><a href="/not-a-hit">y</a></div>',
  '<TABLE id=t class=''main specs''><tr><td class="name wide"><div>Size:</div></td><td><STRONG><div>', p_size,
  '&nbsp;cm</div></STRONG></td></tr><tr><td class=''name wide''>Price:<td><strong>2&nbsp;', p_size, ' Ft</table>') AS html
FROM part"""


def _nested(spark, sf_dir):
    register_tables(spark, sf_dir, ["part"])
    return spark.sql(NESTED_SQL)


@register("a04_nested_blocks", """
SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS block_pos, concat(p_name, chr(160), 'éA', p_brand) AS title,
       concat('/p?a=1&b=', p_partkey) AS href, CAST(NULL AS VARCHAR) AS reject_reason FROM part
UNION ALL SELECT p_partkey, 1, NULL, NULL, 'no anchor in block' FROM part""")
def q_nested_blocks(spark, sf_dir):
    return PG.extract_listing_links(_nested(spark, sf_dir), "div", "hit row", "h3")


@register("a05_nested_tables", """
SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS attr_pos, 'Size:' AS attr, concat(p_size, chr(160), 'cm') AS value FROM part
UNION ALL SELECT p_partkey, 1, 'Price:', concat('2', chr(160), p_size, ' Ft') FROM part""")
def q_nested_tables(spark, sf_dir):
    return PG.explode_attributes(PG.extract_key_values(_nested(spark, sf_dir), "specs", "name wide"))


# ------------------------------------------------------------- A5, A6, A7
@register("a05_extract_key_values", "WITH fx_kv_pages AS (" + FIXTURES["fx_kv_pages"] + "), src AS ("
          + KV_SRC_SQL + "), " + _sql_kv_pairs("src") + """
SELECT src, page_id, CAST(row_number() OVER (PARTITION BY src, page_id ORDER BY i) - 1 AS INTEGER) AS attr_pos,
       attr, value FROM kept""")
def q_key_values(spark, sf_dir):
    kv = PG.extract_key_values(_kv_src(spark, sf_dir), TABLE_CLASS, KEY_CLASS, key=["src", "page_id"])
    return PG.explode_attributes(kv, key=["src", "page_id"])


@register("a06_widen_attributes", "WITH fx_kv_pages AS (" + FIXTURES["fx_kv_pages"] + "), src AS ("
          + KV_SRC_SQL + "), " + _sql_kv_pairs("src") + """
SELECT o.src, o.page_id,
       max(CASE WHEN attr = 'Kivitel:' THEN value END) AS "Kivitel:",
       max(CASE WHEN attr = 'Méret:' THEN value END) AS "Méret:",
       max(CASE WHEN attr = 'Vételár:' THEN value END) AS "Vételár:"
FROM ok o LEFT JOIN kept k ON k.src = o.src AND k.page_id = o.page_id
GROUP BY o.src, o.page_id""")
def q_widen(spark, sf_dir):
    kv = PG.extract_key_values(_kv_src(spark, sf_dir), TABLE_CLASS, KEY_CLASS, key=["src", "page_id"])
    good, _ = PG.quarantine_bad_rows(kv)
    return PG.widen_attributes(good, ATTRIBUTES, key=["src", "page_id"])


@register("a07_quarantine_bad_rows", "WITH fx_kv_pages AS (" + FIXTURES["fx_kv_pages"] + "), src AS ("
          + KV_SRC_SQL + f"""),
t AS (SELECT src, page_id, html, regexp_extract(html, '{_TABLE}', 1) AS tb FROM src),
kv AS (SELECT src, page_id, html, {_sql_blocks('tb', 'td', 'bal pontos')} AS ks, {_sql_blocks('tb', 'strong')} AS vs FROM t)
SELECT src, page_id,
       CASE WHEN NOT regexp_matches(html, '{_TABLE}') THEN 'no attribute table'
            WHEN len(ks) < len(vs) THEN 'fewer keys than values' END AS reject_reason
FROM kv WHERE NOT regexp_matches(html, '{_TABLE}') OR len(ks) < len(vs)""")
def q_quarantine(spark, sf_dir):
    kv = PG.extract_key_values(_kv_src(spark, sf_dir), TABLE_CLASS, KEY_CLASS, key=["src", "page_id"])
    _, rejected = PG.quarantine_bad_rows(kv)
    return rejected.select("src", "page_id", "reject_reason")


# ------------------------------------------------------------- A8
@register("a08_union_listings", f"""
WITH h AS (SELECT page_id, url, {_sql_blocks('html', 'h1')} AS hl FROM pages),
f AS (SELECT page_id, url, unnest(hl) AS blk, unnest(generate_series(0, len(hl) - 1)) AS block_pos FROM h),
b AS (SELECT page_id, {_sql_blocks('html', 'li')} AS bl FROM pages),
r AS (SELECT page_id, unnest(bl) AS blk, unnest(generate_series(0, len(bl) - 1)) AS block_pos FROM b)
SELECT page_id, CAST(block_pos AS INTEGER) AS block_pos, {_sql_text('blk')} AS title, url AS href, 0 AS block_rank FROM f
UNION ALL
SELECT page_id, CAST(block_pos AS INTEGER) AS block_pos, {_sql_text(f"regexp_extract(blk, '{_ANCHOR}', 2)")} AS title,
       regexp_extract(blk, '{_ANCHOR}', 1) AS href, 1 AS block_rank
FROM r WHERE regexp_matches(blk, '{_HAS_ANCHOR}')""")
def q_union_listings(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    featured = PG.headline_blocks(pages, "h1")
    links, _ = PG.quarantine_bad_rows(PG.extract_listing_links(pages, block_tag="li"))
    return PG.union_listings(featured, links)
