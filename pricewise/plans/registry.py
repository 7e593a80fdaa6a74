"""Registry of checked queries: a Spark query and its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the query with the
pricewise operators over fixtures derived from the whole driver tables;
``ORACLE[name]`` is the equivalent SQL text.  Float outputs are rounded to
the same number of digits on both sides (engines differ in the last bits of
sums and interpolations).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round every double column (or the named ones) for comparison."""
    cols = []
    for f in df.schema.fields:
        d = digits.get(f.name) if isinstance(digits, dict) else digits
        if d is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 10^d) / 10^d: the same binary-value rounding DuckDB
            # applies, so exact halves of the decimal string cannot split
            m = float(10 ** d)
            # ``+ 0.0`` turns a rounded -0.0 into 0.0 (as the SQL side does)
            cols.append((F.round(F.col(f.name) * m, 0) / m + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from pricewise.plans import (q_features, q_listings, q_models, q_pages,  # noqa: F401
                                 q_score, q_series)
