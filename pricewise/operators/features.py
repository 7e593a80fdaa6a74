"""Feature engineering, encoding and selection operators (B14, E1, E3-E7,
E9-E12).

Fitted statistics (modes, quantile edges, bin medians, min/max, levels) are
computed by distributed aggregations and applied by joining a one-row (or
one-row-per-bin) frame; the only values that reach the driver are category
levels and quantile edges, because they define output columns or need a
uniqueness check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.operators.profile import correlation_matrix, modes
from pricewise.operators.rank import exact_quantiles, stacked, with_global_rank
from pricewise.session import with_scalars


def _one_row_quantiles(df: DataFrame, col: str, probs: Sequence[float], prefix: str = "_q") -> DataFrame:
    q = exact_quantiles(df, col, probs)
    return q.agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"{prefix}{i}")
                   for i, p in enumerate(probs)])


def filter_upper_fence(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Drop rows with ``x > Q3 + k*IQR`` (no lower fence, so new items
    stay); rows with NULL ``x`` are kept."""
    q = _one_row_quantiles(df, col, [0.25, 0.75])
    fence = q.select((F.col("_q1") + k * (F.col("_q1") - F.col("_q0"))).alias("_ul"))
    j = with_scalars(df, fence)
    return j.where(~F.coalesce(F.col(col) > F.col("_ul"), F.lit(False))).drop("_ul")


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULL categories with the column's most frequent value (ties
    -> smallest); one stacked aggregation for all columns, applied through a
    one-row broadcast frame."""
    cols = list(cols)
    m = modes(df, cols)
    wide = m.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"_m_{i}")
                   for i, c in enumerate(cols)])
    j = with_scalars(df, wide)
    return j.select(*[F.coalesce(F.col(c), F.col(f"_m_{cols.index(c)}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def category_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null levels of every column in long form (``column,
    value``): whatever their number, none of them becomes a column."""
    return stacked(df, list(cols), (), cast="string").where(F.col("value").isNotNull()).distinct()


def one_hot(df: DataFrame, cols: Sequence[str], levels: dict[str, Sequence[str]], drop_first: bool = True,
            sep: str = "_") -> DataFrame:
    """0/1 columns ``col_level`` for the declared ``levels`` in sorted
    order, the first one dropped when ``drop_first``; NULL gives all zeros.
    Non-encoded columns come first (pandas ``get_dummies`` layout).  Levels
    name output columns, so the caller declares them (``category_levels``
    lists those of a table); the same ones encode any other frame alike."""
    cols = list(cols)
    keep = [F.col(c) for c in df.columns if c not in cols]
    flags = []
    for c in cols:
        for v in sorted(levels[c])[1 if drop_first else 0:]:
            flags.append(F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
                         .alias(f"{c}{sep}{v}"))
    return df.select(*keep, *flags)


def smooth_outliers_by_bin(df: DataFrame, cols: Sequence[str], bins: int = 10,
                           suffix: str = "_Handled_Outlier", k: float = 1.5,
                           duplicates: str = "raise") -> DataFrame:
    """For each column, values outside the (strict) ``k`` IQR fences are
    replaced by the median of their quantile bin; others are unchanged.

    Bins follow ``qcut``: edges are the exact ``0, 1/bins, ..., 1``
    quantiles, intervals are right-closed with the lowest value included, so
    the bin of ``x`` is the number of inner edges below ``x``.  Duplicate
    edges raise (``duplicates='raise'``) or are merged (``'drop'``).

    Edges and quartiles for all columns come from one stacked quantile
    pass; bin medians from a second one keyed by (column, bin).  The
    per-column edges (``bins + 1`` numbers) are collected to check
    uniqueness and become literals of the bin expression.
    """
    cols = list(cols)
    probs = sorted(set([i / bins for i in range(bins + 1)] + [0.25, 0.75]))
    long = stacked(df, cols)
    q = exact_quantiles(long, "value", probs, ["column"]).collect()
    table = {(r["column"], round(r["p"], 12)): r["q"] for r in q}
    bin_exprs: dict[str, Column] = {}
    fences: dict[str, tuple[float, float]] = {}
    for c in cols:
        edges = [table.get((c, round(i / bins, 12))) for i in range(bins + 1)]
        if any(e is None for e in edges):
            bin_exprs[c] = F.lit(None).cast("int")
            fences[c] = (None, None)
            continue
        if len(set(edges)) != len(edges):
            if duplicates == "raise":
                raise ValueError(f"bin edges of {c} are not unique: {edges}")
            edges = sorted(set(edges))
        inner = edges[1:-1]
        x = F.col(c)
        b = F.lit(0)
        for e in inner:
            b = b + (x > F.lit(e)).cast("int")
        bin_exprs[c] = F.when(x.isNotNull(), b)
        q1, q3 = table[(c, 0.25)], table[(c, 0.75)]
        fences[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    binned = df.withColumns({f"_bin_{i}": bin_exprs[c] for i, c in enumerate(cols)})
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"_bin_{i}").alias("bin"),
                      F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)]
    long_b = binned.select(F.explode(F.array(*pairs)).alias("_e")).select("_e.*") \
        .where(F.col("bin").isNotNull())
    med = exact_quantiles(long_b, "value", [0.5], ["column", "bin"]).collect()
    # at most len(cols) * bins medians: applied as literal arrays indexed by
    # bin, so the smoothing itself is a single projection (no join)
    medians = {(r["column"], r["bin"]): r["q"] for r in med}
    new = {}
    for i, c in enumerate(cols):
        x = F.col(c)
        lo, hi = fences[c]
        if lo is None:
            new[f"{c}{suffix}"] = x.cast("double")
            continue
        n_bins = max([b for (cc, b) in medians if cc == c], default=-1) + 1
        lut = F.array(*[F.lit(medians.get((c, b))).cast("double") for b in range(n_bins)])
        flag = (x > F.lit(hi)) | (x < F.lit(lo))
        new[f"{c}{suffix}"] = F.when(flag, F.element_at(lut, F.col(f"_bin_{i}") + 1)) \
            .otherwise(x.cast("double"))
    return binned.withColumns(new).drop(*[f"_bin_{i}" for i in range(len(cols))])


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """E5: population variance per column; at threshold 0 the reported
    figure is ``min(variance, max - min)``; ``keep`` = figure > threshold."""
    cols = list(cols)
    agg = df.agg(*[F.var_pop(F.col(c)).alias(f"_v{i}") for i, c in enumerate(cols)],
                 *[(F.max(F.col(c)) - F.min(F.col(c))).cast("double").alias(f"_r{i}") for i, c in enumerate(cols)])
    rows = []
    for i, c in enumerate(cols):
        v = F.least(F.col(f"_v{i}"), F.col(f"_r{i}")) if threshold == 0 else F.col(f"_v{i}")
        rows.append(F.struct(F.lit(c).alias("column"), v.alias("variance")))
    out = agg.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return out.withColumn("keep", F.col("variance") > F.lit(threshold))


def high_correlation_pairs(df: DataFrame, cols: Sequence[str], limit: float = 0.8) -> DataFrame:
    """Pairs (a < b in column order) whose |Pearson r| exceeds ``limit``."""
    cols = list(cols)
    pos = {c: i for i, c in enumerate(cols)}
    m = correlation_matrix(df, cols)
    order = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    return m.where((order[F.col("a")] < order[F.col("b")]) & (F.abs(F.col("corr")) > limit))


def high_correlation_filter(df: DataFrame, cols: Sequence[str], limit: float = 0.8) -> list[str]:
    """Greedy keep list: walk ``cols`` in order and keep a column unless
    it is over ``limit`` with a column already kept (k x k matrix only)."""
    pairs = {(r["a"], r["b"]) for r in high_correlation_pairs(df, cols, limit).collect()}
    kept: list[str] = []
    for c in cols:
        if not any((k, c) in pairs or (c, k) in pairs for k in kept):
            kept.append(c)
    return kept


def select_by_association(assoc: DataFrame, min_abs: float = 0.35) -> DataFrame:
    """Features whose |association| with the target is at least ``min_abs``."""
    return assoc.where(F.abs(F.col("association")) >= min_abs)


def features_label(df: DataFrame, label: str, x_cols: Sequence[str], out: str = "features") -> DataFrame:
    """``label`` + assembled feature vector for ``pyspark.ml``."""
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(x_cols), outputCol=out, handleInvalid="keep")
    return va.transform(df.withColumn("label", F.col(label).cast("double"))).select("label", out)


def split_hash(key: str | Column, seed: int = 42) -> Column:
    """Repeatable 0..999 bucket of a key (md5 based, same in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), k.cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % 1000).cast("int")


def split_share(key: str | Column, seed: int = 42) -> Column:
    """Repeatable place of a key in [0, 1), to 32 bits (md5 based)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), k.cast("string"))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def train_test_split(df: DataFrame, key: str, train_size: float = 0.8, seed: int = 42,
                     exact: bool = False, role_col: str = "role") -> DataFrame:
    """Repeatable shuffled split, no sort and no shuffle (32-bit hash of
    the key).  ``exact=True`` takes exactly ``round(train_size * n)`` rows in
    hash order via a distributed global rank."""
    if not exact:
        role = F.when(split_share(key, seed) < train_size, "train").otherwise("test")
        return df.withColumn(role_col, role)
    h = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    ranked = with_global_rank(h, ["_h", key])
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    j = with_scalars(ranked, n)
    role = F.when(F.col("_rank") <= F.round(F.col("_n") * train_size), "train").otherwise("test")
    return j.withColumn(role_col, role).drop("_h", "_rank", "_n")


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Z-score with the population std; a constant column gives 0."""
    cols = list(cols)
    st = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = with_scalars(df, st)
    new = {}
    for i, c in enumerate(cols):
        s = F.when(F.col(f"_s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_s{i}"))
        new[f"{c}{suffix}"] = (F.col(c) - F.col(f"_m{i}")) / s
    return j.withColumns(new).drop(*[f"_m{i}" for i in range(len(cols))],
                                   *[f"_s{i}" for i in range(len(cols))])


def fit_min_max(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E12 fit: one-row frame of per-column min and max of the training rows."""
    return train.agg(*[F.min(c).cast("double").alias(f"_lo{i}") for i, c in enumerate(cols)],
                     *[F.max(c).cast("double").alias(f"_hi{i}") for i, c in enumerate(cols)])


def apply_min_max(df: DataFrame, fitted: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """E12 transform: ``(x - min) / (max - min)``; a constant training column
    uses a range of 1 (so it maps to ``x - min``); test rows may leave
    [0, 1]."""
    cols = list(cols)
    j = with_scalars(df, fitted)
    new = {}
    for i, c in enumerate(cols):
        rng = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        new[f"{c}{suffix}"] = (F.col(c) - F.col(f"_lo{i}")) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    return j.withColumns(new).drop(*[f"_lo{i}" for i in range(len(cols))],
                                   *[f"_hi{i}" for i in range(len(cols))])
