"""Aggregation, profiling and duplicate operators.

Rules kept from the reference behaviour:
- group keys that are NULL are dropped (pandas ``groupby`` / ``value_counts``
  / ``pivot_table`` / ``crosstab`` drop them, Spark would keep them);
- standard deviations are sample (N-1) unless stated;
- quantiles are exact with linear interpolation (see ``rank.py``).

Loops of the reference (one scan per brand, per key, per column pair) become
one ``stack`` + one ``groupBy`` so each family is a single shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewise.functions.dist import chi2_sf_col
from pricewise.operators.rank import exact_quantiles, stacked
from pricewise.session import with_scalars


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL = NULL, keeping one copy of each key."""
    keys = list(keys)
    if not keys:
        return with_scalars(left, right)  # no keys: a global aggregate
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"_rk_{k}" for k in keys])


# ---------------------------------------------------------------- duplicates
def find_duplicates(df: DataFrame) -> DataFrame:
    """Every row of a full-row duplicate group (``keep=False``).

    Duplicate keys are found with a map-side combined ``groupBy(all).count``
    (a hot repeated row collapses to one row before the shuffle) and joined
    back null-safely.  AQE broadcasts the key table when its
    bytes are few; otherwise it splits skewed partitions of the join.
    """
    cols = df.columns
    dup_keys = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
                .where(F.col("_c") > 1).drop("_c"))
    return _semi_null_safe(df, dup_keys, cols)


def _semi_null_safe(df: DataFrame, keys_df: DataFrame, cols: Sequence[str]) -> DataFrame:
    r = keys_df.select(*[F.col(c).alias(f"_rk_{c}") for c in cols])
    cond = None
    for c in cols:
        e = df[c].eqNullSafe(r[f"_rk_{c}"])
        cond = e if cond is None else cond & e
    return df.join(r, cond, "left_semi")


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Full-row distinct (partial aggregation collapses repeats map-side)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


# ---------------------------------------------------------------- profiles
def schema_profile(df: DataFrame) -> DataFrame:
    """D3: per column position, name, Spark type and non-null count (one scan)."""
    spark = df.sparkSession
    counts = df.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(f"_n{i}").alias("non_null"))
        for i in range(len(df.columns))])).alias("s")).select("s.*")
    return meta.join(long, "position").select("position", "column", "dtype", "non_null")


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % and max per numeric
    column (and group): ``by..., column, count, mean, std, min, q25, q50,
    q75, max``.  Quantiles are exact (``df.summary`` is approximate)."""
    by = list(by)
    long = stacked(df, cols, by)
    if by:
        long = long.where(_all_not_null(by))
    moments = long.groupBy(*by, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], [*by, "column"])
    qw = q.groupBy(*by, "column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("q50"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q75"))
    out = _null_safe_join(moments, qw, [*by, "column"], "left")
    return out.select(*by, "column", F.col("count").cast("long").alias("count"), "mean", "std",
                      "min", "q25", "q50", "q75", "max")


def _all_not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def describe_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """D4 per group, one job instead of one per group."""
    return describe(df, cols, by)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted unique non-null values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency of every non-null level of each column:
    ``column, value, count`` ordered by count desc then value."""
    long = stacked(df, cols, (), cast="string")
    return (long.where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("column", F.desc("count"), "value"))


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Q1, median, Q3, whiskers at the last datum inside ``k`` IQR and
    the count of points outside: ``by..., column, q1, median, q3, iqr,
    whisker_low, whisker_high, n_outliers``."""
    by = list(by)
    long = stacked(df, cols, by).where(F.col("value").isNotNull())
    if by:
        long = long.where(_all_not_null(by))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], [*by, "column"])
    qw = (q.groupBy(*by, "column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("_lo", F.col("q1") - k * F.col("iqr"))
        .withColumn("_hi", F.col("q3") + k * F.col("iqr")))
    j = _null_safe_join(long, qw, [*by, "column"])
    v = F.col("value")
    agg = j.groupBy(*by, "column").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("iqr").alias("iqr"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.count(F.when((v < F.col("_lo")) | (v > F.col("_hi")), 1)).alias("n_outliers"))
    return agg


def histogram(df: DataFrame, col: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram from min to max (top edge in the last bin),
    every bin listed: ``by..., bin, lo, hi, count``."""
    by = list(by)
    base = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if by:
        base = base.where(_all_not_null(by))
    rng = base.groupBy(*by).agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    rng = rng.withColumn("_w", (F.col("_max") - F.col("_min")) / bins)
    j = _null_safe_join(base, rng, by)
    b = F.when(F.col("_w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_min")) / F.col("_w")), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.select(*by, "bin", (F.col("_min") + F.col("bin") * F.col("_w")).alias("lo"),
                       (F.col("_min") + (F.col("bin") + 1) * F.col("_w")).alias("hi"))
    out = _null_safe_join(grid, counts, [*by, "bin"], "left")
    return out.select(*by, "bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def binned_pairs(df: DataFrame, x: str, y: str, nx: int = 10, ny: int = 10) -> DataFrame:
    """2-D equal-width bin counts (non-empty cells): ``bx, by, count``."""
    base = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rng = base.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
                   F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    j = with_scalars(base, rng)
    wx = (F.col("_x1") - F.col("_x0")) / nx
    wy = (F.col("_y1") - F.col("_y0")) / ny
    bx = F.when(wx == 0, 0).otherwise(F.least(F.floor((F.col("_x") - F.col("_x0")) / wx), F.lit(nx - 1)))
    byy = F.when(wy == 0, 0).otherwise(F.least(F.floor((F.col("_y") - F.col("_y0")) / wy), F.lit(ny - 1)))
    return j.groupBy(bx.cast("int").alias("bx"), byy.cast("int").alias("by")) \
        .agg(F.count(F.lit(1)).alias("count"))


TAYLOR = 9           # highest moment of a cell
CELLS_PER_WIDTH = 8  # cells in one bandwidth
REACH = 9.0          # bandwidths beyond which a kernel is below 3e-18


def group_density(df: DataFrame, x: str, by: str, grid: int = 100, cut: float = 2.0) -> DataFrame:
    """Gaussian kernel density per category (violin data), Scott
    bandwidth ``h = std * n^(-1/5)``; evaluated on ``grid`` points from
    ``min - cut*h`` to ``max + cut*h``.

    One pass sums the moments ``d^k``, k <= 9, of the rows' distances d (in
    bandwidths) from the centres of cells an eighth of a bandwidth wide.  A row
    meets no grid point: a cell's kernels at distance a add up to
    ``exp(-a^2/2) sum He_k(a) m_k / k!`` with Hermite polynomials He_k.  As
    |d| <= 1/16 and |He_k(a)| exp(-a^2/2) <= 1.1 sqrt(k!), what is left out is
    below 1e-15 of a kernel's peak per row.
    """
    base = df.select(F.col(by).alias("level"), F.col(x).cast("double").alias("_x")) \
        .where(F.col("level").isNotNull() & F.col("_x").isNotNull())
    st = (base.groupBy("level").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
                                     F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
          .withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), -0.2))
          .where(F.col("_h") > 0)
          .select("level", "_n", "_h", (F.col("_mn") - cut * F.col("_h")).alias("_g0"),
                  ((F.col("_mx") - F.col("_mn") + 2 * cut * F.col("_h")) / (grid - 1)).alias("_gs")))
    width = F.col("_h") / CELLS_PER_WIDTH
    centre = F.col("_g0") + (F.col("_cell") + 0.5) * width
    own = ["level", "_n", "_h", "_g0", "_gs"]
    placed = base.join(st, "level").withColumn("_cell", F.floor((F.col("_x") - F.col("_g0")) / width))
    placed = placed.select(*own, "_cell", ((F.col("_x") - centre) / F.col("_h")).alias("_d"))
    moments = F.array(*[F.sum(F.pow("_d", F.lit(float(k)))) / math.factorial(k) for k in range(TAYLOR + 1)])
    cells = placed.groupBy(*own, "_cell").agg(moments.alias("_m")).withColumn("_c", centre)
    # grid points within reach of the cell, then the sum over cells
    lo = F.greatest(F.lit(0), F.ceil((F.col("_c") - REACH * F.col("_h") - F.col("_g0")) / F.col("_gs")))
    hi = F.least(F.lit(grid - 1), F.floor((F.col("_c") + REACH * F.col("_h") - F.col("_g0")) / F.col("_gs")))
    near = cells.where(lo <= hi).withColumn("gi", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    near = near.withColumn("_a", (F.col("_g0") + F.col("gi") * F.col("_gs") - F.col("_c")) / F.col("_h"))
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    series = F.aggregate("_m", start, lambda s, m: F.struct(
        s["he"].alias("before"), (F.col("_a") * s["he"] - s["k"] * s["before"]).alias("he"),
        (s["k"] + 1.0).alias("k"), (s["sum"] + s["he"] * m).alias("sum")), lambda s: s["sum"])
    summed = near.groupBy("level", "gi").agg(F.sum(F.exp(-F.col("_a") * F.col("_a") / 2) * series).alias("_ks"))
    points = st.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return points.join(summed, ["level", "gi"], "left").select(
        "level", "gi", (F.col("_g0") + F.col("gi") * F.col("_gs")).alias("x"),
        (F.coalesce("_ks", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def pivot_mean(df: DataFrame, index: Sequence[str], values: Sequence[str], order: str | None = None,
               ascending: bool = False) -> DataFrame:
    """Mean of ``values`` by 1..n keys; rows with a NULL key dropped."""
    index = list(index)
    out = df.where(_all_not_null(index)).groupBy(*index).agg(
        *[F.avg(v).alias(v) for v in values])
    if order:
        out = out.orderBy(F.col(order).asc() if ascending else F.col(order).desc())
    return out


def mean_by_each(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """D12 once per key column, as one stack + one groupBy:
    ``key, level, mean`` (NULL levels dropped), each key sorted by mean desc."""
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("level")) for k in keys]
    long = df.select(F.col(value).alias("_y"), F.explode(F.array(*pairs)).alias("_kv")) \
        .select("_y", "_kv.key", "_kv.level").where(F.col("level").isNotNull())
    return long.groupBy("key", "level").agg(F.avg("_y").alias("mean")) \
        .orderBy("key", F.desc("mean"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, pairwise-complete NULL
    handling, as a long square matrix ``a, b, corr`` (one aggregation)."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    agg = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"_c{i}_{j}")
                   for i, j in pairs]) if pairs else None
    entries = []
    for i, a in enumerate(cols):
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("corr")))
    for i, j in pairs:
        entries.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"_c{i}_{j}").alias("corr")))
        entries.append(F.struct(F.lit(cols[j]).alias("a"), F.lit(cols[i]).alias("b"), F.col(f"_c{i}_{j}").alias("corr")))
    src = agg if agg is not None else df.limit(1)
    return src.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def crosstab(df: DataFrame, a: str, b: str, levels: Sequence | None = None) -> DataFrame:
    """Contingency counts in long form ``a, b, count``; rows with a NULL
    in either are dropped.  Observed cells only, unless the caller declares
    the ``levels`` of ``b``: then every level of ``a`` also lists its zero
    cells (and values of ``b`` beyond the declared ones still appear)."""
    base = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    counts = base.groupBy("a", "b").agg(F.count(F.lit(1)).cast("long").alias("count"))
    if levels is None:
        return counts
    # a level of ``a`` adds zeros to its own counts: no join, no list on the driver
    zeros = counts.select("a", F.explode(F.array(*[F.lit(v) for v in levels])).alias("b"), F.lit(0).alias("count"))
    return counts.unionByName(zeros.distinct()).groupBy("a", "b").agg(F.sum("count").alias("count"))


def _pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Observed cells of many contingency tables from one scan:
    ``var1, var2, a, b, o``.  Each row fans out to one entry per pair and
    the count is combined map-side, so only distinct cells are shuffled."""
    entries = [F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"),
                        F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"))
               for x, y in pairs]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*") \
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return long.groupBy("var1", "var2", "a", "b").agg(F.count(F.lit(1)).alias("o"))


def _chi2_from_cells(cells: DataFrame) -> DataFrame:
    """Pearson chi-square per table from observed cells only:
    ``chi2 = sum((O-E)^2/E) + (N - sum(E))``: a zero cell adds its E, and all
    E add up to N.  Tables with one degree of freedom (2 x 2) get
    the Yates correction ``|O-E| -> |O-E| - min(0.5, |O-E|)`` over all four
    cells, zero cells included.  Returns ``var1, var2, chi2, dof, r, c, n``.
    """
    keys = ["var1", "var2"]
    wt = Window.partitionBy(*keys)
    ra = cells.groupBy(*keys, "a").agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(*keys, "b").agg(F.sum("o").alias("cb"))
    dims = cells.groupBy(*keys).agg(F.sum("o").alias("n"), F.countDistinct("a").alias("r"),
                                    F.countDistinct("b").alias("c"))
    # complete 2 x 2 tables so zero cells enter the Yates sum
    two = dims.where((F.col("r") == 2) & (F.col("c") == 2)).select(*keys)
    la = ra.join(two, keys, "left_semi").select(*keys, "a")
    lb = cb.join(two, keys, "left_semi").select(*keys, "b")
    grid = la.join(lb, keys).join(cells, [*keys, "a", "b"], "left").fillna(0, ["o"])
    small = grid.join(ra, [*keys, "a"]).join(cb, [*keys, "b"]).join(dims, keys)
    e = F.col("ra") * F.col("cb") / F.col("n")
    dev = F.abs(F.col("o") - e)
    yates = small.groupBy(*keys).agg(
        F.sum(F.pow(dev - F.least(F.lit(0.5), dev), 2) / e).alias("chi2_y"))
    big = cells.join(ra, [*keys, "a"]).join(cb, [*keys, "b"]).join(dims, keys)
    pear = big.groupBy(*keys).agg(
        (F.sum(F.pow(F.col("o") - e, 2) / e)
         # without zero cells the difference is rounding only
         + F.when(F.count(F.lit(1)) < F.first("r") * F.first("c"), F.greatest(F.first("n") - F.sum(e), F.lit(0.0)))
         .otherwise(0.0)).alias("chi2_p"))
    out = dims.join(pear, keys).join(yates, keys, "left")
    dof = ((F.col("r") - 1) * (F.col("c") - 1)).cast("long")
    chi2 = F.when(dof == 0, F.lit(0.0)).when(dof == 1, F.col("chi2_y")).otherwise(
        F.greatest(F.col("chi2_p"), F.lit(0.0)))
    return out.select(*keys, chi2.alias("chi2"), dof.alias("dof"), "r", "c", F.col("n").cast("long").alias("n"))


def chi2_stat(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of independence: ``chi2, dof, p`` (Yates only
    for one degree of freedom)."""
    res = _chi2_from_cells(_pair_cells(df, [(a, b)]))
    return res.select("chi2", "dof", F.when(F.col("dof") > 0, chi2_sf_col(F.col("chi2"), F.col("dof")))
                      .alias("p"))


def cramers_matrix(df: DataFrame, cols: Sequence[str], digits: int | None = 3,
                   n_rows: int | DataFrame | None = None) -> DataFrame:
    """Cramér's V for every ordered pair of ``cols`` (diagonal
    included): ``var1, var2, cramers_v``.

    ``V = sqrt(chi2 / (N * (min(R, C) - 1)))`` with ``N`` the row count of
    the frame (rows with a NULL in the pair still count, as in the
    reference); ``min_dim = 0`` gives NULL.  All tables come from one scan.
    """
    cols = list(cols)
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i:]]  # V is symmetric
    res = _chi2_from_cells(_pair_cells(df, pairs))
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    j = with_scalars(res, total)
    mind = F.least(F.col("r"), F.col("c")) - 1
    v = F.when(mind > 0, F.sqrt(F.col("chi2") / (F.col("_rows") * mind)))
    if digits is not None:
        v = F.round(v, digits)
    both = F.when(F.col("var1") == F.col("var2"), F.array(F.struct("var1", "var2"))).otherwise(
        F.array(F.struct("var1", "var2"), F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"))))
    return j.select(F.explode(both).alias("_e"), v.alias("cramers_v")).select("_e.var1", "_e.var2", "cramers_v")


def cramers_v(df: DataFrame, a: str, b: str, digits: int | None = 3) -> DataFrame:
    return cramers_matrix(df, [a, b], digits).where((F.col("var1") == a) & (F.col("var2") == b))


def correlation_ratio(df: DataFrame, y: str, by: Sequence[str] | str) -> DataFrame:
    """Correlation ratio H of numeric ``y`` on each categorical column:
    ``feature, between_var, within_var, total_var, H``.

    ``between = sum(n_g (avg_g - mean)^2) / N`` and
    ``within = sum(n_g std_g^2) / N`` (single-row groups have no std and
    are skipped) with ``N`` the row count, over the sample variance of y.
    """
    cats = [by] if isinstance(by, str) else list(by)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cats]
    long = df.select(F.col(y).cast("double").alias("_y"), F.explode(F.array(*pairs)).alias("_kv")) \
        .select("_y", "_kv.feature", "_kv.level").where(F.col("level").isNotNull())
    groups = long.groupBy("feature", "level").agg(
        F.count("_y").alias("_n"), F.avg("_y").alias("_avg"), F.stddev_samp("_y").alias("_std"))
    tot = df.agg(F.count(F.lit(1)).alias("_rows"), F.avg(F.col(y)).alias("_mean"),
                 F.var_samp(F.col(y)).alias("_var"))
    j = with_scalars(groups, tot)
    agg = j.groupBy("feature").agg(
        (F.sum(F.col("_n") * F.pow(F.col("_avg") - F.col("_mean"), 2)) / F.first("_rows")).alias("between_var"),
        (F.sum(F.col("_n") * F.pow(F.col("_std"), 2)) / F.first("_rows")).alias("within_var"),
        F.first("_var").alias("total_var"))
    return agg.withColumn("H", F.sqrt(F.col("between_var") / F.col("total_var")))


def target_association(df: DataFrame, y: str, num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """One row per feature: Pearson r for numerics, H for categoricals:
    ``feature, kind, association``."""
    parts = []
    if num_cols:
        agg = df.agg(*[F.corr(F.col(y).cast("double"), F.col(c).cast("double")).alias(f"_r{i}")
                       for i, c in enumerate(num_cols)])
        parts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.lit("numeric").alias("kind"), F.col(f"_r{i}").alias("association"))
            for i, c in enumerate(num_cols)])).alias("e")).select("e.*"))
    if cat_cols:
        h = correlation_ratio(df, y, cat_cols)
        parts.append(h.select("feature", F.lit("categorical").alias("kind"), F.col("H").alias("association")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D20 for many columns in one pass: ``column, mode, count``."""
    long = stacked(df, cols, (), cast="string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy("column").agg(
        F.min_by(F.col("value"), F.struct(-F.col("_c"), F.col("value"))).alias("mode"),
        F.max("_c").alias("count"))


def best_row(df: DataFrame, metric: str, maximize: bool = True) -> DataFrame:
    """The row with the best ``metric`` (ties broken by the other
    columns so the answer is repeatable); a top-1, not a sort."""
    others = [F.col(c) for c in df.columns if c != metric]
    m = F.col(metric).desc_nulls_last() if maximize else F.col(metric).asc_nulls_last()
    return df.orderBy(m, *others).limit(1)
