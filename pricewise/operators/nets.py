"""Small neural networks, searched by successive halving.

One hidden layer of rectified units on min-max scaled inputs, squared error
with an L2 penalty, full-batch Adam.  All (setting, fold) models train at the
same time: every step is one pass over the rows that adds up the gradients of
all of them, partial sums per task and then one Spark aggregate; only the
parameters - a few dozen numbers per model - are on the driver.  The ranges of
the inputs and the mean and spread of the target come from each model's own
training rows (all folds but the held-out one), so nothing of a held-out fold
leaks into its scaler.

Successive halving gives each rung more steps and only the better part of the
settings.  The state after a rung - parameters, optimiser moments, scores per
fold - is a table in the shared folder; a search that is called again with the
same folder goes on behind the last rung that was written.

Rows with a NULL input or target take no part in the fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.operators.features import split_hash
from pricewise.session import spread, written

#: Hidden units and penalties of the network search.
NET_SPACE = {"hidden": [2, 3, 4, 5], "alpha": [0.0001, 0.001, 0.01], "step": [0.01, 0.03, 0.1]}
SETTINGS, FOLDS = 50, 5
RUNGS = (15, 30, 60, 120)  # steps of each rung
KEPT = 3                   # one setting in so many goes on
ROOM = 1 << 16             # activities [model, unit, row] worked on at once in a task


@dataclass
class Scale:
    """Ranges of the inputs, mean and spread of the target in training rows."""
    low: np.ndarray
    width: np.ndarray
    mean: float
    spread: float
    rows: int


def fold_scales(rows: DataFrame, k: int, folds: int) -> list[Scale | None]:
    """Per held-out fold (the last entry: none held out), from the other folds;
    None where these have no rows.  One row per fold reaches the driver."""
    found = {r["fold"]: r for r in rows.groupBy("fold").agg(
        F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"),
        F.array(*[F.min(f"x{i}") for i in range(k)]).alias("lo"), F.array(*[F.max(f"x{i}") for i in range(k)]).alias("hi")).collect()}
    out: list[Scale | None] = []
    for v in range(folds + 1):
        some = [r for f, r in found.items() if f != v]
        n = sum(r["n"] for r in some)
        if not n:
            out.append(None)
            continue
        low, high = np.min([r["lo"] for r in some], axis=0), np.max([r["hi"] for r in some], axis=0)
        mean = sum(r["s"] for r in some) / n
        spread = math.sqrt(max(sum(r["q"] for r in some) / n - mean * mean, 0.0))
        out.append(Scale(low, np.where(high > low, high - low, 1.0), mean, spread or 1.0, n))
    return out


@dataclass
class Nets:
    """Parameters of many models, [model, ...], padded to the widest layer."""
    setting: np.ndarray
    fold: np.ndarray
    parts: dict[str, np.ndarray]

    @staticmethod
    def begin(settings: Sequence[dict], folds: Sequence[int], k: int, seed: int) -> Nets:
        wide = max(s["hidden"] for s in settings)
        models = [(i, f) for i in range(len(settings)) for f in folds]
        parts = {"w": np.zeros((len(models), k, wide)), "b": np.zeros((len(models), wide)),
                 "out": np.zeros((len(models), wide)), "bias": np.zeros((len(models), 1))}
        for m, (i, f) in enumerate(models):
            rng, h = np.random.default_rng((seed, i, f)), settings[i]["hidden"]
            parts["w"][m, :, :h] = rng.uniform(-1, 1, (k, h)) * math.sqrt(6 / (k + h))
            parts["out"][m, :h] = rng.uniform(-1, 1, h) * math.sqrt(6 / (h + 1))
            parts["b"][m, :h] = rng.uniform(-0.5, 0.5, h)
        return Nets(np.array([i for i, _ in models]), np.array([f for _, f in models]), parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(len(p), -1) for p in self.parts.values()], axis=1)

    def with_flat(self, values: np.ndarray) -> Nets:
        parts, at = {}, 0
        for c, p in self.parts.items():
            size = p[0].size if len(p) else 0
            parts[c] = values[:, at:at + size].reshape(p.shape)
            at += size
        return Nets(self.setting, self.fold, parts)

    def only(self, keep: np.ndarray) -> Nets:
        return Nets(self.setting[keep], self.fold[keep], {c: p[keep] for c, p in self.parts.items()})


def forward(parts: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations [row, model, unit] and outputs [row, model]."""
    m, k, h = parts["w"].shape
    hidden = x @ parts["w"].transpose(1, 0, 2).reshape(k, m * h)
    hidden = np.maximum(hidden.reshape(len(x), m, h) + parts["b"], 0.0)
    return hidden, (hidden * parts["out"]).sum(axis=2) + parts["bias"][:, 0]


def _by_unit(parts: dict[str, np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Models in the order of their hidden units (those with most first), and
    per unit the weights with the bias as last input [input, model] of the
    models that have it, and their number.  Units that only pad are left out."""
    used = (parts["w"] != 0).any(axis=1) | (parts["b"] != 0) | (parts["out"] != 0)
    units = np.where(used.any(axis=1), used.shape[1] - used[:, ::-1].argmax(axis=1), 0)
    order = np.argsort(-units, kind="stable")
    layers = []
    for j in range(units.max(initial=0)):
        some = order[:int((units > j).sum())]
        layers.append((np.concatenate((parts["w"][some, :, j].T, parts["b"][some, j][None, :])), len(some)))
    return order, layers


class _Passing:
    """Models of the same number of hidden units on their way through rows, and
    the sums that they gather.

    Rows are scaled once, by ``base``; each model's own scale is an affine map of
    that, kept in its weights.  A unit's gradients come from one product of the
    rows with the errors where it is active: those of its output weight are its
    own weights times that."""

    def __init__(self, parts: dict[str, np.ndarray], units: int, own: Sequence[Scale], base: Scale):
        self.base, self.shape = base, (len(own), units)
        self.ratio, self.shift = (np.array(a).reshape(len(own), 1, -1) for a in (
            [base.width / s.width for s in own], [(base.low - s.low) / s.width for s in own]))
        w, self.weight = parts["w"].transpose(0, 2, 1)[:, :units], parts["out"][:, None, :units]
        # weights of the scaled rows and the bias [model, unit, input]
        self.layer = np.concatenate((w * self.ratio, (parts["b"][:, :units] + (w * self.shift).sum(axis=2))[:, :, None]), axis=2)
        # the output's bias less the target: factors of the scaled target and of 1
        spread, mean = (np.array([getattr(s, c) for s in own]) for c in ("spread", "mean"))
        self.start = np.stack((-base.spread / spread, parts["bias"][:, 0] - (base.mean - mean) / spread), axis=1)
        self.sums, self.bias = np.zeros(self.layer.shape), np.zeros(len(own))
        # rows at a time: all that one step of them needs stays near the processor
        self.step = max(128, ROOM // max(1, len(own) * units))

    def add(self, ones: np.ndarray, target: np.ndarray) -> None:
        """Scaled rows by column, each with a last one of 1."""
        models, units = self.shape
        flat = self.layer.reshape(models * units, ones.shape[0])
        room = np.empty(models * units * min(self.step, ones.shape[1]))
        mask = np.empty(len(room), dtype=bool)
        for lo in range(0, ones.shape[1], self.step):
            some = ones[:, lo:lo + self.step]
            n = some.shape[1]
            hidden, active = (a[:models * units * n].reshape(models, units, n) for a in (room, mask))
            np.matmul(flat, some, out=hidden.reshape(-1, n))
            np.greater(hidden, 0.0, out=active)
            np.maximum(hidden, 0.0, out=hidden)
            error = self.start @ target[:, lo:lo + n] + np.matmul(self.weight, hidden)[:, 0]
            np.multiply(error[:, None], active, out=hidden)
            self.sums += (hidden.reshape(-1, n) @ some.T).reshape(self.sums.shape)
            self.bias += error.sum(axis=1)

    def gradients(self, wide: int) -> dict[str, np.ndarray]:
        """The sums gathered, as gradients padded to ``wide`` units."""
        models, units = self.shape
        w, weight = self.sums[:, :, :-1] * self.ratio + self.sums[:, :, -1:] * self.shift, self.weight[:, 0]
        pad = ((0, 0), (0, wide - units))
        return {"w": np.pad((w * weight[:, :, None]).transpose(0, 2, 1), ((0, 0), *pad)), "b": np.pad(self.sums[:, :, -1] * weight, pad),
                "out": np.pad((self.sums * self.layer).sum(axis=2), pad), "bias": self.bias[:, None]}


class _Sums:
    """What all models gather from rows that come fold by fold."""

    def __init__(self, nets: Nets, scales: Sequence[Scale]):
        self.nets, self.scales = nets, scales
        self.base = next((scales[v] for v in nets.fold[::-1]), None)
        order, layers = _by_unit(nets.parts)
        self.units = np.zeros(len(nets.setting), dtype=int)
        for _, m in layers:
            self.units[order[:m]] += 1
        self.passing: dict[int, list[tuple[np.ndarray, _Passing]]] = {}
        self.held = np.zeros(len(nets.setting))

    def _of(self, fold: int) -> list[tuple[np.ndarray, _Passing]]:
        out = []
        for units in np.unique(self.units):
            some = np.flatnonzero((self.nets.fold != fold) & (self.units == units))
            if len(some):
                out.append((some, _Passing({c: p[some] for c, p in self.nets.parts.items()}, int(units), [self.scales[v] for v in self.nets.fold[some]], self.base)))
        return out

    def add(self, fold: int, x: np.ndarray, y: np.ndarray, scored: bool) -> None:
        """Rows by column: inputs [input, row] and target [row]."""
        if fold not in self.passing:
            self.passing[fold] = self._of(fold)
        ones = np.concatenate(((x - self.base.low[:, None]) / self.base.width[:, None], np.ones((1, len(y)))))
        target = np.stack(((y - self.base.mean) / self.base.spread, np.ones(len(y))))
        for _, p in self.passing[fold]:
            p.add(ones, target)
        out = np.flatnonzero(self.nets.fold == fold)
        if scored and len(out):
            s, one = self.scales[fold], {c: p[out] for c, p in self.nets.parts.items()}
            for lo in range(0, len(y), 2048):
                z, t = (x[:, lo:lo + 2048].T - s.low) / s.width, (y[lo:lo + 2048] - s.mean) / s.spread
                self.held[out] += ((forward(one, z)[1] - t[:, None]) ** 2).sum(axis=0) * s.spread ** 2

    def gradients(self) -> np.ndarray:
        grads, wide = np.zeros(self.nets.flat().shape), self.nets.parts["b"].shape[1]
        for some, p in (q for found in self.passing.values() for q in found):
            sums = p.gradients(wide)
            grads[some] += np.concatenate([sums[c].reshape(len(some), -1) for c in self.nets.parts], axis=1)
        return grads


def sums_of(nets: Nets, scales: Sequence[Scale], x: np.ndarray, y: np.ndarray, fold: np.ndarray, scored: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Over rows: gradients of half the squared error of every model's training
    rows [model, parameter], and squared errors of its held-out rows in units
    of the target [model] (zeros unless ``scored``)."""
    sums = _Sums(nets, scales)
    for v in np.unique(fold):
        sums.add(int(v), x[fold == v].T, y[fold == v], scored)
    return sums.gradients(), sums.held


def packed(rows: DataFrame, k: int, size: int = 8192) -> DataFrame:
    """``fold, n, block``: up to ``size`` rows of one fold by column, inputs and
    then the target, as bytes.  The rows are read at every step of the search:
    in blocks they reach its tasks without a conversion of each value."""
    def of(batches):
        held: dict[int, list[np.ndarray]] = {}
        count: dict[int, int] = {}

        def block(v, a):
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([a.shape[1]], pa.int32()), pa.array([a.tobytes()], pa.binary())],
                                              names=["fold", "n", "block"])

        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            a = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, k + 2)])
            for v in np.unique(fold).tolist():
                held.setdefault(v, []).append(a[:, fold == v])
                count[v] = count.get(v, 0) + held[v][-1].shape[1]
                if count[v] >= size:
                    a_v = np.concatenate(held[v], axis=1)
                    whole = count[v] - count[v] % size
                    for lo in range(0, whole, size):
                        yield block(v, a_v[:, lo:lo + size])
                    held[v], count[v] = [a_v[:, whole:]], count[v] - whole
        for v in sorted(held):
            if count[v]:
                yield block(v, np.concatenate(held[v], axis=1))

    return rows.select("fold", *[f"x{i}" for i in range(k)], "y").mapInArrow(of, "fold int, n int, block binary")


def _pass(blocks: DataFrame, nets: Nets, scales: Sequence[Scale], k: int, scored: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``sums_of`` over all rows of the ``packed`` table: models x parameters
    numbers reach the driver."""
    shared = blocks.sparkSession.sparkContext.broadcast((nets, scales))

    def partial(batches):
        sums = None
        for batch in batches:
            for v, block in zip(batch.column("fold").to_pylist(), batch.column("block")):
                sums = sums or _Sums(*shared.value)
                a = np.frombuffer(block.as_buffer()).reshape(k + 1, -1)
                sums.add(v, a[:-1], a[-1], scored)
        if sums is not None:
            total = np.concatenate((sums.gradients(), sums.held[:, None]), axis=1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total)], names=["i", "v"])

    found = blocks.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    shared.unpersist()
    width = nets.flat().shape[1] + 1
    out = np.zeros(len(nets.setting) * width)
    out[found["i"].to_numpy()] = found["v"].to_numpy()
    out = out.reshape(-1, width)
    return out[:, :-1], out[:, -1]


def _train(blocks, nets, moments, scales, settings, k, steps, done):
    """``steps`` steps of Adam for all models."""
    n = np.array([scales[f].rows for f in nets.fold])[:, None]
    rate, alpha = (np.array([settings[i][c] for i in nets.setting])[:, None] for c in ("step", "alpha"))
    decayed = np.concatenate([np.full(p[0].size, c in ("w", "out")) for c, p in nets.parts.items()]) * 1.0
    first, second = moments
    for t in range(done + 1, done + steps + 1):
        g = _pass(blocks, nets, scales, k, scored=False)[0] / n + alpha * decayed * nets.flat() / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        nets = nets.with_flat(nets.flat() - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8))
    return nets, (first, second)


STATE = "setting int, fold int, rung int, steps int, rmse double, params array<double>, first array<double>, second array<double>"


def _rung_path(folder: str, rung: int) -> str:
    return f"{folder}/rung-{rung}"


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


@dataclass
class NetSearch:
    """Scores of a finished search and the best setting's model of all rows."""
    scores: DataFrame
    best: int
    inputs: list[str]
    scale: Scale
    parts: dict[str, np.ndarray]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        parts, scale = self.parts, self.scale

        def of(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            guess = forward(parts, (x - scale.low) / scale.width)[1][:, 0] * scale.spread + scale.mean
            return pa.array(guess, from_pandas=True)  # a NULL input gives NULL

        return df.withColumn(out, F.arrow_udf(of, "double")(*[F.col(c).cast("double") for c in self.inputs]))


def search_nets(df: DataFrame, y: str, x: Sequence[str], key: str, settings: Sequence[dict], folder: str, folds: int = FOLDS,
                rungs: Sequence[int] = RUNGS, kept: int = KEPT, seed: int = 7) -> NetSearch:
    """``scores`` has one row per setting, fold and rung that it reached:
    ``setting, fold, rung, steps, rmse`` (held-out, after ``steps`` steps in
    all).  The best setting has the least mean of the last rung, where every
    fold is scored; ties go to the earlier one."""
    spark, x = df.sparkSession, list(x)
    k = len(x)
    whole = F.col(y).isNotNull()
    for c in x:
        whole = whole & F.col(c).isNotNull()
    rows = df.where(whole).select((split_hash(key) % folds).alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)],
                                  F.col(y).cast("double").alias("y"))
    rows, _ = written(rows)
    scales = fold_scales(rows, k, folds)
    if scales[folds] is None:
        raise ValueError("no row has all inputs and the target")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    blocks, _ = written(packed(spread(rows, 1), k))  # a file to every core: each step reads them
    models = [f for f in range(folds + 1) if scales[f] is not None]
    nets = Nets.begin(settings, models, k, seed)
    moments = (np.zeros(nets.flat().shape), np.zeros(nets.flat().shape))
    done = 0
    for rung, steps in enumerate(rungs):
        path = _rung_path(folder, rung)
        if _exists(spark, path):  # a search that was lost goes on here
            state = {(r.setting, r.fold): r for r in spark.read.schema(STATE).parquet(path).collect()}
            nets = nets.only(np.array([(i, f) in state for i, f in zip(nets.setting.tolist(), nets.fold.tolist())]))
            order = [state[i, f] for i, f in zip(nets.setting.tolist(), nets.fold.tolist())]
            nets = nets.with_flat(np.array([r.params for r in order]))
            moments = (np.array([r.first for r in order]), np.array([r.second for r in order]))
            rmse = np.array([np.nan if r.rmse is None else r.rmse for r in order])
        else:
            nets, moments = _train(blocks, nets, moments, scales, settings, k, steps, done)
            sse = _pass(blocks, nets, scales, k)[1]
            n = np.array([sizes.get(f, 0) for f in nets.fold.tolist()], dtype=float)
            rmse = np.sqrt(np.divide(sse, n, out=np.full(len(n), np.nan), where=n > 0))
            spark.createDataFrame(
                [(int(i), int(f), rung, done + steps, None if np.isnan(e) else float(e), p.tolist(), a.tolist(), b.tolist())
                 for i, f, e, p, a, b in zip(nets.setting, nets.fold, rmse, nets.flat(), *moments)], STATE).write.mode("overwrite").parquet(path)
        done += steps
        own = sorted(set(nets.setting.tolist()))
        mean = {i: np.nanmean(rmse[nets.setting == i]) for i in own}
        ranked = sorted(own, key=lambda i: (mean[i], i))
        if rung + 1 < len(rungs):
            going = set(ranked[:max(1, -(-len(own) // kept))])
            keep = np.array([i in going for i in nets.setting.tolist()])
            nets, moments = nets.only(keep), (moments[0][keep], moments[1][keep])
    scores = spark.read.schema(STATE).parquet(*[_rung_path(folder, r) for r in range(len(rungs))])
    scores = scores.where(F.col("fold") < folds).select("setting", "fold", "rung", "steps", "rmse")
    last = nets.only((nets.setting == ranked[0]) & (nets.fold == folds))
    return NetSearch(scores, ranked[0], x, scales[folds], last.parts)
