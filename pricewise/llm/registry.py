"""Queries of this subpackage (``opN_<name>`` and ``pipeline``) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(columns, name: str) -> str:
    """``name``, with underscores in front until no column has it: results
    never take the place of a column of the input."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def load_all() -> None:
    """Import every operator module so that its query is registered."""
    from pricewise.llm import (codelength, decontaminate, fingerprints, importance, infill, langid, licenses, linecrf,  # noqa: F401
                               neardup, sentencepieces, sharding, substrings, tokencount)
