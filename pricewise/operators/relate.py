"""Joins and set operations.

Join strategy is left to Catalyst and AQE, which broadcasts a side when its
measured bytes are few.  C6 is a bounded fan-out instead of
a self-join, so its cost is linear in ``max_shift``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.operators.rank import null_safe_join


def group_stats(df: DataFrame, by: Sequence[str], y: str, prefix: str = "") -> DataFrame:
    """C1 (folded): sample std, mean and count of ``y`` per group, one agg."""
    return df.where(_not_null(by)).groupBy(*by).agg(
        F.stddev_samp(y).alias(f"{prefix}std"), F.avg(y).alias(f"{prefix}avg"),
        F.count(y).alias(f"{prefix}n"))


def join_group_stats(df: DataFrame, by: Sequence[str], y: str, prefix: str = "") -> DataFrame:
    """Left join of the group statistics back onto the rows."""
    stats = group_stats(df, by, y, prefix)
    return df.join(stats, list(by), "left")


def _not_null(cols):
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def lookup_map(df: DataFrame, small: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Per-row dictionary lookup as a left join."""
    return df.join(small, on, "left")


def align_on_date(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Align two frames on (series, date) keys (``concat(axis=1)``)."""
    return a.join(b, list(keys), how)


def pair_counts(df: DataFrame, cols: Sequence[str], ordered: bool = True) -> DataFrame:
    """Contingency cells of every pair of categorical columns from one
    scan: ``var1, var2, a, b, count`` (NULLs dropped); counts are combined
    map-side, so only distinct cells are shuffled."""
    cols = list(cols)
    pairs = [(x, y) for x in cols for y in cols if x != y and (ordered or cols.index(x) < cols.index(y))]
    entries = [F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"),
                        F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"))
               for x, y in pairs]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*") \
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return long.groupBy("var1", "var2", "a", "b").agg(F.count(F.lit(1)).alias("count"))


def rolled_history(df: DataFrame, by: Sequence[str], pos: str, order: str, max_shift: int,
                   min_shift: int = 0, id_col: str = "window_end") -> DataFrame:
    """For every row ``t`` of a series, the sub-series of rows
    ``t - max_shift .. t`` (tsfresh ``roll_time_series``), identified by
    ``(series, order value of t)``.

    ``pos`` is the 1-based position within the series (``positions`` in
    ``series.py``).  Each row is copied to the ``max_shift + 1`` windows
    that contain it (a fixed fan-out, no pairs of rows are formed); the
    window end's order value comes from an equi-join on (series, position).
    Windows shorter than ``min_shift + 1`` rows are dropped.
    """
    by = list(by)
    fan = df.withColumn("_end", F.explode(F.sequence(F.col(pos), F.col(pos) + F.lit(max_shift))))
    ends = df.select(*by, F.col(pos).alias("_end"), F.col(order).alias(id_col))
    out = null_safe_join(fan, ends, [*by, "_end"])
    if min_shift > 0:
        out = out.where(F.col("_end") - F.greatest(F.lit(1), F.col("_end") - max_shift) >= min_shift)
    return out.drop("_end")


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two frames by column name; missing columns become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def drop_by_key(df: DataFrame, bad: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Remove rows whose key appears in ``bad`` (left anti join)."""
    return df.join(bad, key, "left_anti")


def expand_grid(df: DataFrame, **lists) -> DataFrame:
    """C9 over data: every row of ``df`` repeated once per setting of the
    grid (the product of ``lists``), generated inside the row by ``explode``
    so no join is planned; output grows by the grid size only."""
    out = df
    for name, values in lists.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def reindex_dates(calendar: DataFrame, df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """C4: every calendar row with the data row of the same key, NULL where
    the data has none (calendar left join)."""
    return calendar.join(df, keys, "left")

