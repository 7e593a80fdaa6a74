"""Isolation-forest anomaly labels (F9; Liu, Ting and Zhou, 2008).

1. Every tree draws its own ``sample_size`` rows, independently of the other
   trees: those whose hash of (seed, tree, key) is smallest.  A threshold on
   the hash (three times the share needed) keeps the rest away from the
   shuffle.  The draw depends on the rows' unique key alone, so neither the
   partitioning nor the row order changes a label.
2. ``groupBy(tree).applyInPandas`` grows each tree (random feature, random
   split between min and max, depth limit ``ceil(log2(sample_size))``).
3. The forest (``trees x 2^(depth+1)`` nodes: bounded by the parameters,
   not by the data) is broadcast to a vectorized ``pandas_udf`` that
   computes the mean path length of every row.
4. Score ``2^(-E[h] / c(psi))``; the ``contamination`` share with the
   highest scores (exact distributed quantile cut) is labelled -1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from pricewise.operators.rank import exact_quantiles
from pricewise.session import with_scalars

EULER = 0.5772156649


def c_factor(m: float) -> float:
    """Average path length of an unsuccessful BST search over ``m`` points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1) + EULER) - 2.0 * (m - 1) / m


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = x[idx]
        spans = sub.max(axis=0) - sub.min(axis=0)
        cand = np.flatnonzero(spans > 0)
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        lo, hi = sub[:, f].min(), sub[:, f].max()
        t = float(rng.uniform(lo, hi))
        feat[i], thr[i] = f, t
        li = idx[sub[:, f] < t]
        ri = idx[sub[:, f] >= t]
        left[i] = node(li, depth + 1)
        right[i] = node(ri, depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def _path_lengths(x: np.ndarray, trees) -> np.ndarray:
    total = np.zeros(len(x))
    for feat, thr, left, right, size in trees:
        node = np.zeros(len(x), dtype=np.int64)
        depth = np.zeros(len(x))
        active = np.ones(len(x), dtype=bool)
        while active.any():
            f = feat[node]
            leaf = f < 0
            done = active & leaf
            if done.any():
                depth[done] += np.array([c_factor(s) for s in size[node[done]]])
                active &= ~leaf
            if not active.any():
                break
            idx = np.flatnonzero(active)
            go_left = x[idx, f[idx]] < thr[node[idx]]
            node[idx] = np.where(go_left, left[node[idx]], right[node[idx]])
            depth[idx] += 1
        total += depth
    return total / len(trees)


def isolation_scores(df: DataFrame, x: Sequence[str], key: Sequence[str], trees: int = 100,
                     sample_size: int = 256, seed: int = 42, out: str = "anomaly_score") -> DataFrame:
    """Anomaly score per row (higher = more isolated); ``key`` is unique."""
    x, key = list(x), list(key)
    base = df.where(_complete(x))
    n = base.count()
    psi = min(sample_size, n)
    # a tree expects 3 * psi rows below the limit; fewer than psi has odds below 1e-80
    limit = int(min(1.0, 3.0 * sample_size / max(n, 1)) * (1 << 53))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.xxhash64(F.lit(seed), t, *[F.col(k) for k in key]).alias("draw")))
    picked = F.filter(draws, lambda d: F.shiftrightunsigned(d["draw"], 11) < F.lit(limit))
    w = Window.partitionBy("_tree").orderBy(F.shiftrightunsigned("_draw", 11), "_draw")
    samp = (base.select(*[F.col(c).cast("double").alias(c) for c in x], F.explode(picked).alias("_p"))
            .select(*x, F.col("_p.tree").alias("_tree"), F.col("_p.draw").alias("_draw"))
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_draw"))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        sample = pdf.sort_values("_r")[x].to_numpy(dtype=float)
        feat, thr, left, right, size = _grow(sample, rng, max_depth)
        return pd.DataFrame({"_tree": t, "node": np.arange(len(feat)), "feat": feat, "thr": thr,
                             "left": left, "right": right, "size": size})

    nodes = samp.groupBy("_tree").applyInPandas(
        build, "_tree int, node long, feat long, thr double, left long, right long, size long")
    # the forest is bounded by trees x 2^(depth+1) nodes: safe to broadcast
    forest = {}
    for r in nodes.collect():
        forest.setdefault(r["_tree"], []).append(r)
    packed = []
    for t in sorted(forest):
        rows = sorted(forest[t], key=lambda r: r["node"])
        packed.append(tuple(np.array([getattr(r, k) for r in rows]) for k in ("feat", "thr", "left", "right", "size")))
    bc = df.sparkSession.sparkContext.broadcast(packed)
    # normalised by the samples really drawn
    cn = float(np.mean([c_factor(size[0]) for *_, size in packed])) if packed else 0.0
    cn = cn or 1.0

    @F.pandas_udf(DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        mat = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(np.power(2.0, -_path_lengths(mat, bc.value) / cn))

    return df.withColumn(out, F.when(_complete(x), score(*[F.col(c).cast("double") for c in x])))


def _complete(cols):
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def isolation_anomalies(df: DataFrame, x: Sequence[str], key: Sequence[str], contamination: float = 0.01,
                        trees: int = 100, sample_size: int = 256, seed: int = 42,
                        label: str = "anomaly") -> DataFrame:
    """label -1 for the ``contamination`` share of rows with the highest
    isolation score, 1 otherwise."""
    scored = isolation_scores(df, x, key, trees, sample_size, seed)
    cut = exact_quantiles(scored, "anomaly_score", [1 - contamination]) \
        .select(F.col("q").alias("_cut"))
    j = with_scalars(scored, cut)
    return j.withColumn(label, F.when(F.col("anomaly_score") > F.col("_cut"), -1).otherwise(1)).drop("_cut")
