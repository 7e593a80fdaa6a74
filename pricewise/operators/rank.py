"""Distributed exact ranks and quantiles.

Spark's ``percentile`` aggregate keeps a value -> count map per group in one
aggregation buffer, which cannot hold a continuous column at cluster scale,
and an unpartitioned ``Window.orderBy`` funnels every row through one task.
The operators here get exact answers with neither.  ``exact_quantiles`` brackets
each target rank by a sketch and orders only the bracket.  Ranks of all values:

1. ``groupBy(by, value).count()``: a map-side combined shuffle that collapses
   every repeated value (a value held by a third of all rows becomes one
   row).
2. ``repartitionByRange(by, value)`` + ``sortWithinPartitions``: each
   partition holds a contiguous, bounded slice of the sorted distinct values,
   so a large group spans many partitions instead of one task.
3. A per-partition running sum (``mapInPandas``, NumPy cumsum in the task)
   plus a small table of per-(partition, group) totals gives every distinct
   value its global cumulative count.  That table has at most
   ``partitions + groups`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``left[k]`` and ``right['_r_' + k]``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copy of a small frame whose key columns are prefixed, so a join back
    to the frame it was derived from has no ambiguous columns."""
    return df.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in df.columns])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the left keys stay."""
    keys = list(keys)
    if not keys:
        raise ValueError("a join needs a key")
    r = _renamed(right, keys)
    return left.join(r, _null_safe_on(left, r, keys), how).drop(*[f"_r_{k}" for k in keys])


def _running_sum(group_col: str | None, weight_col: str, out_col: str):
    """Per-partition running sum of ``weight_col`` that restarts whenever
    ``group_col`` changes; rows arrive sorted within the partition."""

    def fn(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None
        carry = 0
        for pdf in batches:
            if pdf.empty:
                pdf["_pid"] = pd.Series(dtype="int32")
                pdf[out_col] = pd.Series(dtype="int64")
                yield pdf
                continue
            w = pdf[weight_col].to_numpy(dtype=np.int64)
            cs = np.cumsum(w)
            if group_col is None:
                starts = np.zeros(len(w), dtype=bool)
            else:
                g = pdf[group_col].to_numpy()
                starts = np.empty(len(w), dtype=bool)
                starts[0] = last_key is None or g[0] != last_key
                starts[1:] = g[1:] != g[:-1]
                last_key = g[-1]
            # base = running total just before the current group start
            base = np.where(starts, cs - w, 0)
            idx = np.where(starts, np.arange(len(w)), 0)
            idx = np.maximum.accumulate(idx)
            base = base[idx]
            has_start = np.maximum.accumulate(starts)
            # rows before the first start of this batch continue the carry
            out = np.where(has_start, cs - base, cs + carry)
            carry = int(out[-1])
            pdf["_pid"] = np.int32(pid)
            pdf[out_col] = out.astype(np.int64)
            yield pdf

    return fn


def ranked_value_counts(df: DataFrame, value: str | Column, by: Sequence[str] = ()
                        ) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their global cumulative counts per group.

    Returns ``(ranked, sizes)``:
    ``ranked`` has ``by..., _v, _cnt, _cum, _n`` where ``_cum`` is the number
    of non-null rows of the group with a value ``<= _v``; ``sizes`` has
    ``by..., _n`` (non-null rows per group, one small row per group).
    """
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    vc = (df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
          .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_cnt")))
    if by:
        vc = vc.withColumn("_g", F.xxhash64(*by))
    ranged = vc.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v")
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_pid", T.IntegerType()), T.StructField("_lcum", T.LongType())])
    local = ranged.mapInPandas(_running_sum("_g" if by else None, "_cnt", "_lcum"), schema)
    local = local.persist(StorageLevel.MEMORY_AND_DISK)

    tot = local.groupBy("_pid", *by).agg(F.max("_lcum").alias("_ptot"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    off = (tot.withColumn("_off", F.coalesce(F.sum("_ptot").over(before), F.lit(0)))
           .withColumn("_n", F.sum("_ptot").over(whole))
           .select("_pid", *by, "_off", "_n"))
    off = off.persist(StorageLevel.MEMORY_AND_DISK)
    off_b = _renamed(off, ["_pid", *by])

    ranked = (local.join(off_b, _null_safe_on(local, off_b, ["_pid", *by]))
              .select(*[local[b] for b in by], local["_v"], local["_cnt"],
                      (local["_lcum"] + off_b["_off"]).alias("_cum"), off_b["_n"]))
    sizes = off.groupBy(*by).agg(F.max("_n").alias("_n"))
    return ranked, sizes


SKETCH = 10_000   # the sketch misses a rank by at most a share of 1 / SKETCH of the rows


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per group: ``by...,
    p, q``.  A NULL group key is a group of its own.

    Selection by brackets, in two passes: a sketch gives every target rank a
    value surely below and one surely above it; then rows below a bracket are
    only counted, and only the values inside (about 8 in 10,000 rows, equal ones
    counted together) are put in order.  A group of up to ``SKETCH`` rows is its
    own bracket.  Nothing is cached and no job runs while the plan is built."""
    by, probs = list(by), sorted({float(p) for p in probs})
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    slack = 4.0 / SKETCH
    around = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", around, SKETCH).alias("_at"))
    small = F.col("_n") <= SKETCH
    k = len(probs)
    bounds = sketch.select(*by, "_n",
                           F.when(small, F.array_repeat(F.col("_min"), k)).otherwise(F.slice("_at", 1, k)).alias("_los"),
                           F.when(small, F.array_repeat(F.col("_max"), k)).otherwise(F.slice("_at", k + 1, k)).alias("_his"))
    if by:
        held = null_safe_join(rows, bounds, by)
    else:
        row = bounds.select(F.struct("_n", "_los", "_his").alias("_row")).scalar()
        held = rows.select("_v", *[row.getField(c).alias(c) for c in ("_n", "_los", "_his")])
    places = F.array(*[F.lit(i) for i in range(k)])
    inside = F.filter(places, lambda i: (F.get(F.col("_los"), i) <= F.col("_v")) & (F.col("_v") <= F.get(F.col("_his"), i)))
    # a row lies below all brackets from the first one on whose lower end is above it
    first = F.size(F.filter("_los", lambda x: x <= F.col("_v")))
    parts = F.concat(F.array(F.struct(first.alias("i"), F.lit(None).cast("double").alias("v"))),
                     F.transform(inside, lambda i: F.struct(i.alias("i"), F.col("_v").alias("v"))))
    cells = (held.select(*by, "_n", F.explode(parts).alias("_e")).select(*by, "_n", "_e.i", "_e.v")
             .groupBy(*by, "_n", "i", "v").agg(F.count(F.lit(1)).alias("_cnt")))
    return _at_ranks(cells, probs, by)


def _at_ranks(cells: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The quantiles from ``by..., _n, i, v, _cnt``: rows inside bracket ``i``
    by value, and with a NULL value the rows that lie below all brackets from
    ``i`` on."""
    bracket = Window.partitionBy(*by, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*by).orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum(F.when(F.col("v").isNull(), F.col("_cnt")).otherwise(F.lit(0))).over(group)
    upto = F.sum(F.when(F.col("v").isNotNull(), F.col("_cnt")).otherwise(F.lit(0))).over(bracket)
    ranked = (cells.withColumns({"_below": below, "_upto": upto}).where(F.col("v").isNotNull())
              .withColumns({"_cum": F.col("_below") + F.col("_upto"), "_p": F.get(F.array(*map(F.lit, probs)), F.col("i"))}))
    h = (F.col("_n") - 1) * F.col("_p")

    def holds(rank: Column) -> Column:
        return (rank > F.col("_cum") - F.col("_cnt")) & (rank <= F.col("_cum"))

    picked = ranked.withColumns({"_lo": holds(F.floor(h) + 1), "_hi": holds(F.ceil(h) + 1), "_frac": h - F.floor(h)}).where(
        F.col("_lo") | F.col("_hi"))
    two = picked.groupBy(*by, "_p").agg(F.max(F.when(F.col("_lo"), F.col("v"))).alias("_vlo"),
                                        F.max(F.when(F.col("_hi"), F.col("v"))).alias("_vhi"), F.max("_frac").alias("_frac"))
    return two.select(*by, F.col("_p").alias("p"), (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("q"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``exact_quantiles`` of several columns, ``column, p, q``, in two passes
    for all of them: the brackets (a few dozen numbers per column) come to the
    driver, and tasks look them up for whole batches of rows, one array search
    a column."""
    cols, probs = list(cols), sorted({float(p) for p in probs})
    slack, k = 4.0 / SKETCH, len(probs)
    around = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    r = values.agg(*[f for i in range(len(cols)) for f in (
        F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}"),
        F.percentile_approx(f"v{i}", around, SKETCH).alias(f"at{i}"))]).first()
    bounds = [None if not r[f"n{i}"] else (np.full(k, r[f"min{i}"]), np.full(k, r[f"max{i}"])) if r[f"n{i}"] <= SKETCH
              else (np.array(r[f"at{i}"][:k]), np.array(r[f"at{i}"][k:])) for i in range(len(cols))]

    def counted(batches):
        for batch in batches:
            for c, found in enumerate(bounds):
                if found is None:
                    continue
                v = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                # both ends are in order: a value is inside the brackets from ``ended`` to before ``first``
                first, ended = np.searchsorted(found[0], v, side="right"), np.searchsorted(found[1], v, side="left")
                base, times = np.unique(first, return_counts=True)
                wide = np.maximum(first - ended, 0)
                at = np.repeat(np.arange(len(v)), wide)
                place = ended[at] + np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                kinds, n = np.unique(np.stack((place, v[at])), axis=1, return_counts=True) if len(at) else (np.zeros((2, 0)), np.zeros(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(base) + len(n), c), pa.int32()), pa.array(np.concatenate((base, kinds[0])), pa.int32(), safe=False),
                     pa.array([*[None] * len(base), *kinds[1]], pa.float64()), pa.array(np.concatenate((times, n)), pa.int64(), safe=False)],
                    names=["c", "i", "v", "n"])

    cells = values.mapInArrow(counted, "c int, i int, v double, n long").groupBy("c", "i", "v").agg(F.sum("n").alias("_cnt"))
    sizes = F.element_at(F.array(*[F.lit(r[f"n{i}"]).cast("long") for i in range(len(cols))]), F.col("c") + 1)
    name = F.element_at(F.array(*map(F.lit, cols)), F.col("c") + 1)
    return _at_ranks(cells.select(name.alias("column"), sizes.alias("_n"), "i", "v", "_cnt"), probs, ["column"])


def few_values(df: DataFrame, cols: Sequence[str], most: int) -> dict[str, list[float]]:
    """The distinct values, in order, of the columns that have at most ``most``;
    a task passes on no more than one value above that."""
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])

    def some(batches):
        seen = [np.zeros(0) for _ in cols]
        for batch in batches:
            for i, old in enumerate(seen):
                if len(old) <= most:
                    seen[i] = np.unique(np.concatenate((old, batch.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0)))
        for i, v in enumerate(seen):
            v = v[:most + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), pa.int32()), pa.array(v)], names=["c", "v"])

    found = values.mapInArrow(some, "c int, v double").groupBy("c").agg(F.sort_array(F.collect_set("v")).alias("v")).collect()
    return {cols[r["c"]]: r["v"] for r in found if len(r["v"]) <= most}


def stacked(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
            name_col: str = "column", value_col: str = "value", cast: str = "double") -> DataFrame:
    """Unpivot numeric ``cols`` into ``(by..., column, value)`` rows so one
    shuffle serves every column at once."""
    pairs = [F.struct(F.lit(c).alias(name_col), F.col(c).cast(cast).alias(value_col)) for c in cols]
    return (df.select(*by, F.explode(F.array(*pairs)).alias("_kv"))
            .select(*by, f"_kv.{name_col}", f"_kv.{value_col}"))


def with_global_rank(df: DataFrame, order: Sequence[str], rank_col: str = "_rank") -> DataFrame:
    """Attach a 1-based global row number in ``order`` without one task.

    ``order`` must be a unique key.  Rows are range-partitioned and sorted on
    it; ``monotonically_increasing_id`` then encodes (partition, position),
    and per-partition row counts (a table of at most ``partitions`` rows)
    give each partition its offset.  The result is persisted so a
    recomputation cannot renumber rows that were already consumed.
    """
    order = list(order)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    with_id = (ranged.withColumn("_mid", F.monotonically_increasing_id())
               .withColumn("_pid", F.shiftright("_mid", 33))
               .persist(StorageLevel.MEMORY_AND_DISK))
    counts = with_id.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition: a single-task window over this table is
    # bounded by the partition count, not by the data
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_pc").over(w), F.lit(0)))
    out = (with_id.join(F.broadcast(offsets), "_pid")
           .withColumn(rank_col, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
           .drop("_mid", "_pid", "_pc", "_first", "_off"))
    return out


def _edge_pairs(order: list[str], cols: list[str]):
    """Per partition: sums of squared successive differences plus the first
    and last row, for a boundary-stitched global reduction."""

    def fn(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        first = None
        last = None
        n = 0
        sq = np.zeros(len(cols))
        ss = np.zeros(len(cols))
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[cols].to_numpy(dtype=float)
            if last is not None:
                sq += (x[0] - last) ** 2
            if len(x) > 1:
                sq += ((x[1:] - x[:-1]) ** 2).sum(axis=0)
            ss += (x ** 2).sum(axis=0)
            if first is None:
                first = x[0].copy()
            last = x[-1].copy()
            n += len(x)
        if n == 0:
            return
        row = {"_pid": pid, "_n": n}
        for i, c in enumerate(cols):
            row[f"{c}__sqdiff"] = float(sq[i])
            row[f"{c}__sumsq"] = float(ss[i])
            row[f"{c}__first"] = float(first[i])
            row[f"{c}__last"] = float(last[i])
        yield pd.DataFrame([row])

    return fn


def successive_difference_sums(df: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row: ``n``, and per column ``sum((x_t - x_{t-1})^2)`` and
    ``sum(x_t^2)`` in the global ``order`` (a unique key).

    Each range partition reduces itself in one pass; the partition
    boundaries are stitched with a window over one row per partition.
    """
    order, cols = list(order), list(cols)
    ranged = df.select(*order, *cols).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [T.StructField("_pid", T.IntegerType()), T.StructField("_n", T.LongType())]
    for c in cols:
        fields += [T.StructField(f"{c}__{k}", T.DoubleType())
                   for k in ("sqdiff", "sumsq", "first", "last")]
    parts = ranged.mapInPandas(_edge_pairs(order, cols), T.StructType(fields))
    w = Window.orderBy("_pid")
    aggs = [F.sum("_n").alias("n")]
    stitched = parts
    for c in cols:
        stitched = stitched.withColumn(
            f"{c}__edge", F.pow(F.col(f"{c}__first") - F.lag(f"{c}__last").over(w), 2))
    for c in cols:
        aggs += [(F.sum(f"{c}__sqdiff") + F.coalesce(F.sum(f"{c}__edge"), F.lit(0.0))).alias(f"{c}_sqdiff"),
                 F.sum(f"{c}__sumsq").alias(f"{c}_sumsq")]
    return stitched.agg(*aggs)
