"""The listing collector re-aimed at a table of fetched pages.

Pages arrive as rows ``(page_id, url, html)``; every operator here is a
per-row projection.  Markup is read by an HTML parser (``markup``) in
Arrow-batched column functions, one page at a time; a page without markup
(NULL) has no elements.  Parsing costs far more than moving a page, and small
files come as one or two partitions, so the pages are dealt out to all cores
first (``spread``).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.session import spread
from pricewise.sources.markup import elements, select


def page_requests(templates: DataFrame, template_col: str = "template", start: int = 1,
                  stop: int = 252, step: int = 50) -> DataFrame:
    """A3: URL frontier.  Every template with a ``{}`` placeholder gets one
    request per page number in ``range(start, stop, step)``; the page numbers
    are generated inside each row (no join)."""
    pages = F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step))
    return (templates
            .select("*", F.posexplode(pages).alias("page_pos", "page_no"))
            .withColumn("url", F.replace(F.col(template_col), F.lit("{}"), F.col("page_no").cast("string"))))


def extract_listing_links(pages: DataFrame, block_tag: str = "li", block_class: str | None = None,
                          title_tag: str | None = None, key: Sequence[str] = ("page_id",),
                          html: str = "html") -> DataFrame:
    """A4: one row per listing block with the title text and link of its
    first anchor (inside the first ``title_tag`` when given, as the
    ``<h3><a>`` of a result list).  Blocks may hold nested tags of their own
    kind.  Blocks without an anchor keep NULL ``title``/``href`` and a
    ``reject_reason`` (the collector skipped them; see A7)."""

    @F.pandas_udf("array<struct<title:string,href:string>>")
    def links(column: pd.Series) -> pd.Series:
        def page(text):
            found = elements(text)
            out = []
            for block in select(found, block_tag, block_class):
                scope = [block] if title_tag is None else select(found, title_tag, within=block)[:1]
                anchor = next((a for s in scope for a in select(found, "a", within=s) if a.attrs.get("href") is not None), None)
                out.append({"title": anchor.text() if anchor else None, "href": anchor.attrs["href"] if anchor else None})
            return out
        return column.map(page)

    out = spread(pages.select(*key, html)).select(*key, F.posexplode_outer(links(html)).alias("block_pos", "_block")) \
        .where(F.col("_block").isNotNull())
    return out.select(*key, "block_pos", "_block.title", "_block.href",
                      F.when(F.col("_block.href").isNull(), F.lit("no anchor in block")).alias("reject_reason"))


def extract_key_values(pages: DataFrame, table_class: str, key_class: str, value_tag: str = "strong",
                       key_tag: str = "td", key: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """A5: the detail table of a page as an array of ``(key, value)`` structs.

    The i-th key cell is paired with the i-th value element, both as trimmed
    text.  A repeated key keeps its last value (the collector assigned into a
    dict).  Pages without the table, or with fewer key cells than values, get
    ``attrs = NULL`` and a ``reject_reason``.
    """

    @F.pandas_udf("struct<attrs:array<struct<key:string,value:string>>,reject_reason:string>")
    def details(column: pd.Series) -> pd.DataFrame:
        def page(text):
            found = elements(text)
            tables = select(found, "table", table_class)
            if not tables:
                return None, "no attribute table"
            keys = select(found, key_tag, key_class, within=tables[0])
            values = select(found, value_tag, within=tables[0])
            if len(keys) < len(values):
                return None, "fewer keys than values"
            last = {}
            for k, v in zip(keys, values):
                name = k.text()
                last.pop(name, None)  # a repeated key moves to its last place
                last[name] = v.text()
            return [{"key": k, "value": v} for k, v in last.items()], None
        return pd.DataFrame([page(t) for t in column], columns=["attrs", "reject_reason"])

    # Not deterministic for the optimizer: else a filter on the reason (A7) parses every page
    # a second time, below the spread.
    found = details.asNondeterministic()(html).alias("_d")
    return spread(pages.select(*key, html)).select(*key, found).select(*key, "_d.attrs", "_d.reject_reason")


def explode_attributes(kv: DataFrame, key: Sequence[str] = ("page_id",)) -> DataFrame:
    """Long form ``(key..., attr_pos, attr, value)`` of A5's arrays.

    The default shape: it holds any number of attribute names.
    ``posexplode_outer`` plus a filter on the generated struct keeps the
    optimizer from pushing a second copy of the extraction below the scan."""
    return kv.select(*key, F.posexplode_outer("attrs").alias("attr_pos", "_kv")) \
        .where(F.col("_kv").isNotNull()) \
        .select(*key, "attr_pos", F.col("_kv.key").alias("attr"), F.col("_kv.value").alias("value"))


def widen_attributes(kv: DataFrame, keys: Sequence[str], key: Sequence[str] = ("page_id",)) -> DataFrame:
    """Ragged key/value arrays -> one column per declared attribute name,
    NULL where a page lacks it.  A pure projection (no shuffle, no pivot);
    names nobody declared stay in the long form (``explode_attributes``)."""
    def value_of(name: str) -> Column:
        return F.element_at(F.filter("attrs", lambda p: p["key"] == F.lit(name)), 1)["value"].alias(name)

    cols = [value_of(n) for n in keys]
    return kv.select(*key, *cols)


def headline_blocks(pages: DataFrame, tag: str = "h1", key: Sequence[str] = ("page_id",),
                    html: str = "html", url: str = "url") -> DataFrame:
    """Featured entries of a page: the text of every ``<tag>`` block, linked
    to the page itself."""

    @F.pandas_udf("array<string>")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [e.text() for e in select(elements(t), tag)])

    return spread(pages.select(*key, url, html)).select(*key, url, F.posexplode_outer(texts(html)).alias("block_pos", "title")) \
        .where(F.col("title").isNotNull()) \
        .select(*key, "block_pos", "title", F.col(url).alias("href"))


def quarantine_bad_rows(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Split into (good rows, rejected rows with their reason).  The
    collector dropped failures silently; the rejected side is kept here."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def union_listings(featured: DataFrame, regular: DataFrame, rank_col: str = "block_rank") -> DataFrame:
    """Featured blocks ahead of regular ones; order is carried by a
    literal rank column (rows have no position in Spark)."""
    return featured.withColumn(rank_col, F.lit(0)).unionByName(
        regular.withColumn(rank_col, F.lit(1)), allowMissingColumns=True)
