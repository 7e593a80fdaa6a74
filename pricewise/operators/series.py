"""Per-series time operators.

A daily price series is ``(series keys..., d, values...)``.  Order-dependent
operators never put a whole series into one task:

* ``positions`` numbers rows 1..n within each series with the distributed
  global rank of ``rank.py`` (range partitioning splits a long series over
  many partitions);
* ``blocked`` cuts every series into blocks of at most ``BLOCK_ROWS``
  positions and copies the last ``lookback`` rows of each block into the
  next one as a halo, so ``Window.partitionBy(series, block)`` sees bounded
  partitions and lags / rolling windows up to ``lookback`` stay exact;
* unbounded scans (back fill, forward fill) run inside each block and take
  a carry from a small per-block table (``rows / BLOCK_ROWS`` rows).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from pricewise.functions.dist import chi2_sf_col
from pricewise.operators.rank import null_safe_join, with_global_rank

BLOCK_ROWS = 1_000_000


# ---------------------------------------------------------------- layout
def positions(df: DataFrame, by: Sequence[str], order: str, pos_col: str = "_pos") -> DataFrame:
    """1-based position of each row within its series in ``order`` (unique
    within a series), without a per-series window.  A NULL series key is a
    series of its own."""
    by = list(by)
    ranked = with_global_rank(df, [*by, order], "_grank")
    first = ranked.groupBy(*by).agg(F.min("_grank").alias("_gfirst"))
    out = null_safe_join(ranked, first, by)
    return out.withColumn(pos_col, F.col("_grank") - F.col("_gfirst") + 1).drop("_grank", "_gfirst")


def dense(df: DataFrame, by: Sequence[str], pos: str) -> DataFrame:
    """``pos`` numbered 1..n again in its own order, after rows were dropped."""
    return positions(df, by, pos, "_dense").drop(pos).withColumnRenamed("_dense", pos)


def series_lengths(df: DataFrame, by: Sequence[str], pos: str = "_pos") -> DataFrame:
    return df.groupBy(*by).agg(F.max(pos).alias("_len"))


def blocked(df: DataFrame, pos: str, lookback: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign ``_blk`` and add halo copies (``_halo = true``) of the last
    ``lookback`` rows of each block into the following block."""
    if lookback >= block_rows:
        raise ValueError("lookback must be smaller than the block size")
    p = F.col(pos) - 1
    blk = F.floor(p / block_rows).cast("long")
    in_tail = (p % block_rows) >= (block_rows - lookback)
    shift = F.explode(F.when(in_tail & F.lit(lookback > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.withColumn("_sh", shift).withColumn("_blk", blk + F.col("_sh")) \
        .withColumn("_halo", F.col("_sh") == 1).drop("_sh")


def block_window(by: Sequence[str], pos: str) -> Window:
    return Window.partitionBy(*by, "_blk").orderBy(pos)


def with_window_columns(df: DataFrame, by: Sequence[str], pos: str, lookback: int,
                        make: dict[str, callable], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add columns computed over a bounded ordered window per series.

    ``make[name](w)`` returns a Column using the window spec ``w`` and may
    look back at most ``lookback`` rows.  ``pos`` must have no holes within a
    series (see ``dense``): halos are cut by position.
    """
    b = blocked(df, pos, lookback, block_rows)
    w = block_window(by, pos)
    b = b.withColumns({name: fn(w) for name, fn in make.items()})
    return b.where(~F.col("_halo")).drop("_blk", "_halo")


def _fill_many(df: DataFrame, by: Sequence[str], pos: str, cols: dict[str, str], forward: bool,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill NULLs of every ``cols`` key (output name = value) from the
    nearest non-null value before (``forward``) or after it in the series.

    All columns share one block window, one per-block edge aggregation and
    one join with the carries, so the input is read by a single plan branch
    pair whatever the number of columns."""
    by = list(by)
    b = df.withColumn("_blk", F.floor((F.col(pos) - 1) / block_rows).cast("long"))
    w = Window.partitionBy(*by, "_blk").orderBy(pos)
    wb = Window.partitionBy(*by).orderBy("_blk")
    inner, edges, carries = {}, [], []
    for i, c in enumerate(cols):
        if forward:
            inner[f"_in{i}"] = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
            edges.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_edge{i}"))
            carries.append(F.last(f"_edge{i}", ignorenulls=True)
                           .over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry{i}"))
        else:
            inner[f"_in{i}"] = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
            edges.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_edge{i}"))
            carries.append(F.first(f"_edge{i}", ignorenulls=True)
                           .over(wb.rowsBetween(1, Window.unboundedFollowing)).alias(f"_carry{i}"))
    b = b.withColumns(inner)
    # carry: nearest non-null value in an earlier (ffill) / later (bfill)
    # block, from a table of one row per block
    per_blk = b.groupBy(*by, "_blk").agg(*edges).select(*by, "_blk", *carries)
    j = null_safe_join(b, per_blk, [*by, "_blk"], "left")
    n = len(cols)
    return j.withColumns({out: F.coalesce(F.col(f"_in{i}"), F.col(f"_carry{i}"))
                          for i, out in enumerate(cols.values())}) \
        .drop("_blk", *[f"_in{i}" for i in range(n)], *[f"_carry{i}" for i in range(n)])


def _fill(df: DataFrame, by: Sequence[str], pos: str, col: str, out: str, forward: bool,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    return _fill_many(df, by, pos, {col: out}, forward, block_rows)


# ---------------------------------------------------------------- F1, F2
def fill_missing_dates(df: DataFrame, by: Sequence[str], d: str, impute: dict | None = None,
                       pos: str | None = None) -> DataFrame:
    """complete daily calendar from the first to the last day of every
    series; new rows get ``impute`` values (existing NULLs stay).  ``pos``
    names a column for the day's 1-based place in the calendar, which has no
    holes: a filled series needs no ranking (one row per series and day)."""
    by = list(by)
    rng = df.where(F.col(d).isNotNull()).groupBy(*by).agg(F.min(d).alias("_d0"), F.max(d).alias("_d1"))
    cal = rng.select(*by, F.explode(F.sequence("_d0", "_d1", F.expr("INTERVAL 1 DAY"))).alias(d),
                     *([F.col("_d0")] if pos else []))
    if pos:
        cal = cal.withColumn(pos, (F.datediff(d, "_d0") + 1).cast("long")).drop("_d0")
    marked = df.withColumn("_present", F.lit(True))
    out = null_safe_join(cal, marked, [*by, d], "left")
    if impute:
        out = out.withColumns({c: F.when(F.col("_present").isNull(), F.lit(v)).otherwise(F.col(c))
                               for c, v in impute.items()})
    return out.drop("_present")


def backfill(df: DataFrame, by: Sequence[str], pos: str, cols: Sequence[str],
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """replace NULL by the next non-null value of the series."""
    return _fill_many(df, by, pos, {c: c for c in cols}, forward=False, block_rows=block_rows)


# ---------------------------------------------------------------- F3-F8
# The names of the output columns (``recent_mean_7``, ``1_week_pct_growth``, ...).
def diff(df: DataFrame, by: Sequence[str], pos: str, cols: Sequence[str], n: int = 1,
         dropna: bool = True) -> DataFrame:
    """``c - lag(c, n)`` for each column; then rows with a NULL are dropped
    and the rest is numbered afresh, so that lags and windows may follow."""
    out = with_window_columns(df, by, pos, n, {
        c: (lambda w, c=c: F.col(c) - F.lag(c, n).over(w)) for c in cols})
    return dense(out.dropna(subset=list(cols)), by, pos) if dropna else out


def add_lags(df: DataFrame, by: Sequence[str], pos: str, col: str, lags: Sequence[int]) -> DataFrame:
    """``{col}_lag_value_{k}`` columns."""
    return with_window_columns(df, by, pos, max(lags), {
        f"{col}_lag_value_{k}": (lambda w, k=k: F.lag(col, k).over(w)) for k in lags})


def rolling_stats(df: DataFrame, by: Sequence[str], pos: str, col: str, w: int,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """trailing mean, sample std, min and max over ``w`` rows; NULL until
    ``w`` non-null values are in the window."""
    def guard(expr_fn):
        return lambda win: F.when(F.count(col).over(win.rowsBetween(-(w - 1), 0)) == w,
                                  expr_fn(win.rowsBetween(-(w - 1), 0)))
    return with_window_columns(df, by, pos, w - 1, {
        f"recent_mean_{w}": guard(lambda r: F.avg(col).over(r)),
        f"recent_std_dev_{w}": guard(lambda r: F.stddev_samp(col).over(r)),
        f"recent_min_{w}": guard(lambda r: F.min(col).over(r)),
        f"recent_max_{w}": guard(lambda r: F.max(col).over(r)),
    }, block_rows)


def pct_change(df: DataFrame, by: Sequence[str], pos: str, col: str, n: int = 1,
               out: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``x / lag(x, n) - 1`` after a forward fill (pandas' default pad);
    a zero base gives NULL."""
    out = out or f"{col}_pct_change_{n}"
    filled = _fill(df, by, pos, col, "_ff", forward=True, block_rows=block_rows)
    res = with_window_columns(filled, by, pos, n, {
        out: lambda w: F.try_divide(F.col("_ff"), F.lag("_ff", n).over(w)) - 1}, block_rows)
    return res.drop("_ff")


def growth_features(df: DataFrame, by: Sequence[str], pos: str, col: str, week: int = 7,
                    month: int = 30, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """F6 + F7: ``1_week_pct_growth`` and ``growth_volatility_past_month``
    (trailing sample std of the 1-row growth over ``month`` rows)."""
    filled = _fill(df, by, pos, col, "_ff", forward=True, block_rows=block_rows)
    # one layout for both layers: the oldest growth used needs the value ``month`` rows back
    b = blocked(filled, pos, max(week, month), block_rows)
    w = block_window(by, pos)
    recent = w.rowsBetween(-(month - 1), 0)

    def growth(n: int) -> Column:
        return F.try_divide(F.col("_ff"), F.lag("_ff", n).over(w)) - 1

    b = b.withColumns({"1_week_pct_growth": growth(week), "_g1": growth(1)}).withColumn(
        "growth_volatility_past_month",
        F.when(F.count("_g1").over(recent) == month, F.stddev_samp("_g1").over(recent)))
    return b.where(~F.col("_halo")).drop("_blk", "_halo", "_ff", "_g1")


def additional_regressors(df: DataFrame, by: Sequence[str], pos: str, col: str, w: int) -> DataFrame:
    """F5-F7 together (the reference's feature builder)."""
    return growth_features(rolling_stats(df, by, pos, col, w), by, pos, col)


def fourier_terms(df: DataFrame, pos: str, m: float, k: int) -> DataFrame:
    """F8: ``fourier_s{m}_{i} = sin(2 pi i t / m)`` and ``fourier_c{m}_{i}``
    for i = 1..k with t = position (1..n); k <= m / 2."""
    if k > m / 2:
        raise ValueError("k must be at most m / 2")
    t = F.col(pos).cast("double")
    cols = {}
    mm = int(m) if float(m).is_integer() else m
    for i in range(1, k + 1):
        cols[f"fourier_s{mm}_{i}"] = F.sin(F.lit(2 * math.pi * i / m) * t)
        cols[f"fourier_c{mm}_{i}"] = F.cos(F.lit(2 * math.pi * i / m) * t)
    return df.withColumns(cols)


# ---------------------------------------------------------------- F11, F12, F19
def overlap_products(z: np.ndarray, halo: int, lags: int) -> np.ndarray:
    """``sum z_t z_(t-k)`` for k = 0..lags over the rows t behind the first
    ``halo`` ones, by one correlation with the fast Fourier transform."""
    size = 1 << (2 * len(z) - 1).bit_length()
    own = z.copy()
    own[:halo] = 0.0
    full = np.fft.irfft(np.fft.rfft(own, size) * np.conj(np.fft.rfft(z, size)), size)
    out = np.zeros(lags + 1)
    k = min(lags + 1, len(z))
    out[:k] = full[:k]
    return out


def acf(df: DataFrame, by: Sequence[str], pos: str, col: str, lags: int = 10,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """biased autocorrelation ``sum(z_t z_{t-k}) / sum(z_t^2)`` with
    ``z = x - mean``: ``by..., lag, acf`` for lag 0..``lags``.  NULL values
    are left out first and the rest is numbered afresh, so a lag is a number
    of values whatever holes the positions have.  One grouped pass over blocks
    gives the products of all lags, hundreds as well as ten."""
    by = list(by)
    base = dense(df.where(F.col(col).isNotNull()).select(*by, pos, col), by, pos)
    mean = base.groupBy(*by).agg(F.avg(col).alias("_mu"))
    z = null_safe_join(base, mean, by).select(*by, pos, (F.col(col) - F.col("_mu")).alias("_z"))
    blocks = blocked(z, pos, lags, block_rows)
    schema = T.StructType([z.schema[b] for b in by] + [T.StructField("lag", T.IntegerType()), T.StructField("_s", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def products(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        halo = int(np.count_nonzero(table["_halo"].to_numpy()))
        sums = overlap_products(table["_z"].to_numpy().astype(float), halo, lags)
        keys = [pa.array([table[b][0].as_py()] * len(sums), arrow.field(b).type) for b in by]
        return pa.Table.from_arrays([*keys, pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], schema=arrow)

    sums = blocks.groupBy(*by, "_blk").applyInArrow(products, schema).groupBy(*by, "lag").agg(F.sum("_s").alias("_s"))
    whole = Window.partitionBy(*by)  # lags + 1 rows a series
    return sums.select(*by, "lag", (F.col("_s") / F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(whole)).alias("acf"))


def _durbin_levinson(r: np.ndarray, lags: int) -> np.ndarray:
    out = np.zeros(lags + 1)
    out[0] = 1.0
    phi = np.zeros(lags + 1)
    for k in range(1, lags + 1):
        num = r[k] - np.dot(phi[1:k], r[1:k][::-1])
        den = 1.0 - np.dot(phi[1:k], r[1:k])
        pkk = num / den if den != 0 else np.nan
        new = phi.copy()
        new[k] = pkk
        for j in range(1, k):
            new[j] = phi[j] - pkk * phi[k - j]
        phi = new
        out[k] = pkk
    return out


def pacf(df: DataFrame, by: Sequence[str], pos: str, col: str, lags: int = 10,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """partial autocorrelation by Durbin-Levinson on the biased ACF
    (Yule-Walker, MLE-style variance): ``by..., lag, pacf``.  The recursion
    runs per series on its ``lags + 1`` ACF values only."""
    by = list(by)
    a = acf(df, by, pos, col, lags, block_rows)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema.fields if f.name in by]
                       + ["lag int", "pacf double"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(dtype=float)
        p = _durbin_levinson(r, len(r) - 1)
        out = pd.DataFrame({"lag": pdf["lag"].to_numpy(dtype="int32"), "pacf": p})
        for b in by:
            out.insert(len(out.columns) - 2, b, pdf[b].iloc[0])
        return out[[*by, "lag", "pacf"]]

    return a.groupBy(*by).applyInPandas(fn, schema)


def ljung_box(df: DataFrame, by: Sequence[str], pos: str, col: str, lags: int = 5,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``Q_L = n(n+2) sum_{k<=L} r_k^2 / (n-k)`` and its chi-square p
    for L = 1..``lags``: ``by..., lag, lb_stat, lb_pvalue``."""
    by = list(by)
    a = acf(df, by, pos, col, lags, block_rows).where(F.col("lag") > 0)
    n = df.where(F.col(col).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    j = null_safe_join(a, n, by)
    term = F.col("_n") * (F.col("_n") + 2) * F.pow(F.col("acf"), 2) / (F.col("_n") - F.col("lag"))
    w = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = j.withColumn("lb_stat", F.sum(term).over(w))  # at most ``lags`` rows per series
    return q.select(*by, "lag", "lb_stat", chi2_sf_col(F.col("lb_stat"), F.col("lag")).alias("lb_pvalue"))


# ---------------------------------------------------------------- F14, F15, F20
def future_frame(df: DataFrame, by: Sequence[str], d: str, pos: str, h: int,
                 exog: Sequence[str], target: Sequence[str] = ()) -> DataFrame:
    """append ``h`` future days after each series' last day; exogenous
    columns are shifted ``h`` rows forward (so future rows carry the last
    ``h`` known values) and the first ``h`` rows are cut.  Targets stay on
    their own rows (NULL on future rows)."""
    by = list(by)
    n = series_lengths(df, by, pos)
    last = null_safe_join(df, n, by).where(F.col(pos) == F.col("_len")) \
        .select(*by, F.col(d).alias("_dl"), "_len")
    fut = last.select(*by, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("_k"), "_dl", "_len") \
        .select(*by, (F.col("_len") + F.col("_k")).alias(pos), F.date_add("_dl", F.col("_k")).alias(d))
    frame = df.select(*by, pos, d, *target).unionByName(fut, allowMissingColumns=True)
    ex = df.select(*by, (F.col(pos) + h).alias(pos), *exog)
    return null_safe_join(frame, ex, [*by, pos], "left").where(F.col(pos) > h)


def last_n_holdout(df: DataFrame, by: Sequence[str], pos: str, h: int = 30, role_col: str = "role") -> DataFrame:
    """the last ``h`` rows of each series are ``test``, the rest ``train``."""
    n = series_lengths(df, by, pos)
    j = null_safe_join(df, n, list(by))
    return j.withColumn(role_col, F.when(F.col(pos) > F.col("_len") - h, "test").otherwise("train")).drop("_len")


def time_series_folds(df: DataFrame, by: Sequence[str], pos: str, n_splits: int = 5,
                      test_size: int = 30) -> DataFrame:
    """expanding-window folds: fold i tests the block of ``test_size``
    rows starting at ``n - (n_splits - i) * test_size`` and trains on all
    earlier rows.  ``by..., fold, pos, role`` (each row in every fold it
    takes part in: a fan-out of at most ``n_splits``)."""
    n = series_lengths(df, by, pos)
    j = null_safe_join(df, n, list(by))
    j = j.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_len") - (F.lit(n_splits) - F.col("fold")) * test_size + 1
    role = F.when(F.col(pos) < start, "train").when(F.col(pos) < start + test_size, "test")
    return j.withColumn("role", role).where(F.col("role").isNotNull() & (start > 1)).drop("_len")


# ---------------------------------------------------------------- F18, F21
def information_criteria(sse: Column, n: Column, k: Column) -> tuple[Column, Column, Column]:
    """Gaussian log-likelihood, AIC and BIC from SSE, rows and params."""
    nn = n.cast("double")
    ll = -nn / 2 * (F.log(2 * math.pi * sse / nn) + 1)
    return ll, 2 * k - 2 * ll, k * F.log(nn) - 2 * ll


#: The seasons and their keys.
SEASON_KEYS = {
    "monthly": ("month", "dayofmonth"),
    "weekly": ("weekofyear", "dayofweek"),
    "yearly": ("year", "month"),
}


def _calendar(kind: str, d: Column) -> Column:
    return {
        "month": F.month(d), "dayofmonth": F.dayofmonth(d), "weekofyear": F.weekofyear(d),
        "dayofweek": F.weekday(d), "year": F.year(d),
    }[kind]


def seasonality(df: DataFrame, d: str, value: str, kind: str = "yearly", by: Sequence[str] = ()) -> DataFrame:
    """mean of ``value`` by (first key, second key) of the chosen
    season: long form ``by..., across, down, mean`` (pandas' pivot has the
    second key down and the first across).  ``dayofweek`` is Monday = 0."""
    a, b = SEASON_KEYS[kind]
    return df.where(F.col(value).isNotNull()).groupBy(
        *by, _calendar(a, F.col(d)).alias("across"), _calendar(b, F.col(d)).alias("down")
    ).agg(F.avg(value).alias("mean"))
