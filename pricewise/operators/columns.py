"""Projection and row-selection operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """B1: drop named columns; ``strict`` raises on a missing name (Spark's
    ``drop`` silently ignores it)."""
    cols = list(dict.fromkeys(cols))
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in cols if c in df.columns])


def keep_columns(df: DataFrame, include: Sequence[str] | None = None,
                 exclude: Sequence[str] | None = None) -> DataFrame:
    """B2: ordered subset (``include``) or complement (``exclude``)."""
    if include is not None:
        return df.select(*include)
    exclude = set(exclude or ())
    return df.select(*[c for c in df.columns if c not in exclude])


def columns_of_type(df: DataFrame, kind: str, skip_first: bool = False) -> list[str]:
    """B3 helper: names of numeric or categorical (string) columns."""
    if kind == "numeric":
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    elif kind == "categorical":
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    else:
        raise ValueError("kind must be 'numeric' or 'categorical'")
    return names[1:] if skip_first else names


def select_by_type(df: DataFrame, kind: str, skip_first: bool = False) -> DataFrame:
    """The numeric or categorical columns of a frame."""
    return df.select(*columns_of_type(df, kind, skip_first))


def reorder_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Move ``first`` to the front, keep the rest in order."""
    first = list(first)
    return df.select(*first, *[c for c in df.columns if c not in first])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename many columns at once."""
    return df.withColumnsRenamed(mapping)


def fill_nulls_where(df: DataFrame, col: str, values: Column | str) -> DataFrame:
    """Fill NULLs of ``col`` from a predicted value on the same row."""
    v = F.col(values) if isinstance(values, str) else values
    return df.withColumn(col, F.coalesce(F.col(col), v))


def row_subset(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Boolean row selection (pushed to the scan when possible)."""
    return df.where(predicate)


def head(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in an explicit order (Spark rows have none).

    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject: each partition
    keeps its own top ``n`` and only ``n * partitions`` rows reach one task.
    """
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, order: Sequence[str], position: int, col: str) -> DataFrame:
    """One cell at a 0-based position of an explicit ascending order.

    The order's offset is planned as a bounded top-k (no unpartitioned
    window); a position past the end gives no row.
    """
    return df.orderBy(*[F.col(c).asc() for c in order]).offset(position).limit(1).select(col)
