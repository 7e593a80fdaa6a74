"""ARIMA(p, d, q) with exogenous regressors by conditional least squares
(F17), residuals, forecasts, and the backtest of several orders (F22).

With ``w`` the d-th difference of the series (regressors are differenced alike)
the model is ``w_t = c + sum phi_k w_(t-k) + sum b_j x_tj + e_t + sum theta_k
e_(t-k)``, shocks before the first complete row being 0.  The constant is left
out for d > 0 unless asked for.

A series is cut into blocks, each packed once into one row with a halo of the
rows before it.  Shocks obey a linear recursion, so a block's shocks are those
for a zero state before it plus the response to the state it really starts
from.  One pass computes, for every block, series and order at once, the cross
products of both parts; then the blocks' states are carried along a table of
one row per block, which turns the products into the exact sum of squares and
normal equations of the whole series.  A damped Gauss-Newton step follows for
each (series, order).  Starting values are Hannan-Rissanen's: a long
autoregression, then one Gram of all lags and shocks of which every order
takes its sub-block; no fit is worse than its start.

Positions must be 1..n without holes (``series.dense``).  Rows with a missing
value or lag have no shock of their own and count in no sum.  A NULL series
key is a series of its own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricewise.operators.rank import null_safe_join
from pricewise.operators.series import blocked, series_lengths, with_window_columns
from pricewise.session import cut_lineage, remove_written, written

BLOCK_ROWS = 1 << 16
LONG_AR = 10
ROUNDS = 30
SETTLED = 1e-6    # relative gain of a step that ends the search

Order = tuple[int, int, int]


@dataclass(frozen=True)
class Shape:
    """Which columns a model has: constant, lags, regressors, shocks."""
    p: int
    q: int
    exog: int
    const: bool

    @property
    def linear(self) -> int:
        return int(self.const) + self.p + self.exog

    @property
    def size(self) -> int:
        return self.linear + self.q


# -- the recursion --------------------------------------------------------------

def shock_filter(theta: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``v_t = z_t - sum theta_k v_(t-k)`` for every column of ``z``, zero
    before the first row.  Runs of about sqrt(n) rows advance together; their
    states are then carried from run to run."""
    q, (n, m) = len(theta), z.shape
    if not q or not n:
        return z.copy()
    run = max(q, int(math.sqrt(n)))
    runs = -(-n // run)
    v = np.zeros((runs, run, m))
    v.reshape(-1, m)[:n] = z
    response = np.zeros((run, q))
    for t in range(run):
        response[t, :max(0, q - t)] = -theta[t:]
        for k in range(1, min(q, t) + 1):
            v[:, t] -= theta[k - 1] * v[:, t - k]
            response[t] -= theta[k - 1] * response[t - k]
    state = v[0, ::-1][:q]
    for r in range(1, runs):
        v[r] += response @ state
        state = v[r, ::-1][:q]
    return v.reshape(-1, m)[:n]


def _before(x: np.ndarray, pre: np.ndarray, k: int) -> np.ndarray:
    """Column values ``k`` rows earlier; ``pre`` holds the rows before the first."""
    return np.concatenate((pre, x))[len(pre) - k:len(pre) - k + len(x)]


@dataclass
class Block:
    """Rows of one block: ``z[:halo]`` are copies of the rows before it."""
    first: int       # position of the first own row
    halo: int
    z: np.ndarray    # w, regressors

    def columns(self, shape: Shape, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(w, constant, lags, regressors) of the own rows, 0 where one is
        missing, and which rows are whole."""
        w = self.z[:, 0]
        lags = [np.concatenate((np.full(min(k, len(w)), np.nan), w[:len(w) - min(k, len(w))])) for k in range(1, shape.p + 1)]
        parts = [w, *([np.ones(len(w))] if shape.const else []), *lags, *self.z[:, 1:].T]
        x = np.stack(parts, axis=1)[self.halo:]
        whole = np.isfinite(x).all(axis=1) & (self.first + np.arange(len(x)) > d + shape.p)
        return np.where(whole[:, None], x, 0.0), whole


def block_sums(block: Block, shape: Shape, d: int, params: np.ndarray) -> dict[str, np.ndarray]:
    """Cross products of a block for a zero state and of the responses to a
    state, and both at its end."""
    theta, q = params[shape.linear:], shape.q
    x, whole = block.columns(shape, d)
    n, zero, still, unit = len(x), np.zeros((q, q)), np.zeros((q, 1)), np.eye(q)[::-1]
    v = shock_filter(theta, x)
    e = v[:, 0] - v[:, 1:] @ params[:shape.linear]
    g = shock_filter(theta, e[:, None])
    kick = np.zeros((n, q))
    for t in range(min(n, q)):
        kick[t, :q - t] = -theta[t:]
    h = shock_filter(theta, kick)       # response of a shock to the q shocks before the block
    hh = shock_filter(theta, h)
    lags = range(1, q + 1)
    a = np.concatenate([e[:, None], v[:, 1:], *[_before(g, still, k) for k in lags], h,
                        *[_before(hh, zero, k) for k in lags], *[_before(h, unit, k) for k in lags]], axis=1) * whole[:, None]

    def last(c, pre):
        return np.concatenate((pre, c))[::-1][:q]

    return {"products": a.T @ a, "v": last(v, np.zeros((q, v.shape[1]))), "g": last(g, still)[:, 0],
            "h": last(h, unit), "hh": last(hh, zero), "n": np.array(float(whole.sum()))}


def carried(blocks: Sequence[dict[str, np.ndarray]], shape: Shape, params: np.ndarray):
    """Sum of squares, normal equations, rows, last shocks, and the state each
    block starts from, over the blocks of a series in order."""
    q, m = shape.q, shape.linear
    v, g, shocks = np.zeros((q, m + 1)), np.zeros(q), np.zeros(q)
    total, rows, starts = np.zeros((1 + shape.size, 1 + shape.size)), 0, []
    for b in blocks:
        starts.append(shocks)
        to = np.zeros((len(b["products"]), 1 + shape.size))
        to[:1 + shape.size] = np.eye(1 + shape.size)
        at = 1 + shape.size
        to[at:at + q, 0] = shocks
        to[at:at + q, 1:1 + m] = v[:, 1:]
        for k in range(q):
            to[at + q * (1 + k):at + q * (2 + k), 1 + m + k] = shocks
            to[at + q * (1 + q + k):at + q * (2 + q + k), 1 + m + k] = g
        total += to.T @ b["products"] @ to
        rows += int(b["n"])
        g = b["g"] + b["hh"] @ shocks + b["h"] @ g
        v = b["v"] + b["h"] @ v
        shocks = v[:, 0] - v[:, 1:] @ params[:m]
    return float(total[0, 0]), total[1:, 1:], -total[1:, 0], rows, shocks, starts


def invertible(theta: np.ndarray) -> bool:
    """All roots of the shock polynomial outside the unit circle."""
    if not len(theta):
        return True
    companion = np.eye(len(theta), k=-1)
    companion[0] = -theta
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.9999)


def damped_step(jtj: np.ndarray, jte: np.ndarray, params: np.ndarray, shape: Shape, damping: float) -> np.ndarray:
    """The next parameters, shortened until they are invertible."""
    scale = np.sqrt(np.maximum(np.diag(jtj), 0.0))
    scale[scale == 0] = 1.0
    unit = jtj / np.outer(scale, scale) + damping * np.eye(len(scale))
    step = -np.linalg.lstsq(unit, jte / scale, rcond=1e-13)[0] / scale
    for _ in range(60):
        if invertible((params + step)[shape.linear:]):
            break
        step = step / 2
    return params + step


# -- passes over the blocks -------------------------------------------------------

def _fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[b] for b in by]


def _like(by_fields: list[T.StructField], spec: str) -> T.StructType:
    return T.StructType([*by_fields, *T._parse_datatype_string(spec).fields])


def _row_pass(df: DataFrame, schema: T.StructType, of: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``mapInArrow`` over single rows that yields tuples of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(of(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
    return df.mapInArrow(run, schema)


def _group_pass(df: DataFrame, keys: list[str], schema: T.StructType, of: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = list(of(table.to_pylist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)
    return df.groupBy(*keys).applyInArrow(run, schema)


def _packed(df: DataFrame, by: list[str], pos: str, y: str, exog: Sequence[str], d: int, halo: int, block_rows: int) -> DataFrame:
    """One row per block: ``by..., _blk, first, halo, z``."""
    def difference(c):
        return lambda w: sum((F.lag(F.col(c).cast("double"), j).over(w) * float((-1) ** j * math.comb(d, j)) for j in range(1, d + 1)),
                             F.col(c).cast("double"))

    names = [f"_z{i}" for i in range(1 + len(exog))]
    made = with_window_columns(df.select(*by, pos, y, *[c for c in dict.fromkeys(exog) if c != y]), by, pos, d,
                               {n: difference(c) for n, c in zip(names, [y, *exog])}, max(block_rows, d + 1))
    own = [*by, "_blk"]
    schema = _like([*_fields(df, by), T.StructField("_blk", T.LongType())], "first long, halo int, z binary")
    arrow = to_arrow_schema(schema)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        z = np.stack([table[c].to_numpy() for c in names], axis=1).astype(float)
        before = int(np.count_nonzero(table["_halo"].to_numpy()))
        if before == len(z):  # the halo of a block that has no row of its own
            return arrow.empty_table()
        first = table[pos][before].as_py()
        return pa.Table.from_arrays([*[pa.array([table[b][0].as_py()], arrow.field(b).type) for b in own], pa.array([first], pa.int64()),
                                     pa.array([before], pa.int32()), pa.array([z.tobytes()], pa.binary())], schema=arrow)

    return blocked(made.select(*by, pos, *names), pos, halo, max(block_rows, halo + 1)).groupBy(*own).applyInArrow(pack, schema)


def _block(row: dict, columns: int) -> Block:
    return Block(row["first"], row["halo"], np.frombuffer(row["z"]).reshape(-1, columns))


def _bytes(sums: dict[str, np.ndarray]) -> bytes:
    return pickle.dumps(sums)


def _unbytes(packed: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(packed)


def _beside(blocks: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Blocks joined with a row per series, by (series, block), so that the
    blocks of one long series stay spread out."""
    per_block = null_safe_join(blocks.select(*by, "_blk"), small, by)
    return null_safe_join(blocks, per_block, [*by, "_blk"])


def _solve(products: np.ndarray, xs: list[int], yi: int) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(products)[xs], 0.0))
    scale[scale == 0] = 1.0
    return np.linalg.lstsq(products[np.ix_(xs, xs)] / np.outer(scale, scale), products[xs, yi] / scale, rcond=1e-12)[0] / scale


def _starting_values(blocks: DataFrame, by: list[str], shapes: list[Shape], d: int, exog: int, long_ar: int) -> DataFrame:
    """Hannan-Rissanen: ``by..., starts``, a list of parameters per order."""
    deep = Shape(long_ar, 0, 0, True)
    most = Shape(max(s.p for s in shapes), 0, exog, shapes[0].const)
    shocks = max(s.q for s in shapes)
    key = _fields(blocks, by)

    def long_sums(row):
        x, _ = Block(row["first"], row["halo"], np.frombuffer(row["z"]).reshape(-1, 1 + exog)[:, :1]).columns(deep, d)
        yield (*[row[b] for b in by], (x.T @ x).tobytes())

    def long_fit(rows):
        a = sum(np.frombuffer(r["a"]).reshape(deep.linear + 1, -1) for r in rows)
        yield (*[rows[0][b] for b in by], _solve(a, list(range(1, deep.linear + 1)), 0).tolist())

    fitted = _group_pass(_row_pass(blocks, _like(key, "a binary"), long_sums), by, _like(key, "ar array<double>"), long_fit)

    def gram(row):
        b, ar = _block(row, 1 + exog), np.array(row["ar"])
        ahead = Block(b.first - b.halo, 0, b.z[:, :1])  # the halo's shocks are lags too
        x, whole = ahead.columns(deep, d)
        e = np.where(whole, x[:, 0] - x[:, 1:] @ ar, np.nan)
        own, ok = b.columns(most, d)
        late = [_before(e, np.full(shocks, np.nan), k)[b.halo:] for k in range(1, shocks + 1)]
        a = np.column_stack([own, *late])
        a = np.where((ok & np.isfinite(a).all(axis=1))[:, None], a, 0.0)
        yield (*[row[c] for c in by], (a.T @ a).tobytes())

    width = 1 + most.linear + shocks

    def start(rows):
        a = sum(np.frombuffer(r["a"]).reshape(width, width) for r in rows)
        out = []
        c = int(most.const)
        for s in shapes:
            xs = [*range(1, 1 + c + s.p), *range(1 + c + most.p, 1 + c + most.p + exog), *range(1 + most.linear, 1 + most.linear + s.q)]
            params = _solve(a, xs, 0)
            while not invertible(params[s.linear:]):
                params[s.linear:] *= 0.9
            out.append(params.tolist())
        yield (*[rows[0][b] for b in by], out)

    sums = _row_pass(_beside(blocks, fitted, by), _like(key, "a binary"), gram)
    return _group_pass(sums, by, _like(key, "starts array<array<double>>"), start)


STATE = ("model int, trial array<double>, best array<double>, sse double, jtj array<double>, jte array<double>, n long, "
         "shocks array<double>, damping double, failed int, done boolean, first_sse double")


def _sums_at(blocks: DataFrame, at: DataFrame, by: list[str], shapes: list[Shape], d: int, exog: int) -> DataFrame:
    """``by..., model, _blk, sums`` for the parameters ``by..., model, at``."""
    lists = at.groupBy(*by).agg(F.collect_list(F.struct("model", "at")).alias("models"))  # one entry per order

    def of(row):
        b = _block(row, 1 + exog)
        for m in row["models"]:
            sums = block_sums(b, shapes[m["model"]], d, np.array(m["at"]))
            yield (*[row[c] for c in by], m["model"], row["_blk"], m["at"], _bytes(sums))

    return _row_pass(_beside(blocks, lists, by), _like(_fields(blocks, by), "model int, _blk long, at array<double>, sums binary"), of)


def _in_order(rows: list[dict], shapes: list[Shape]):
    rows = sorted(rows, key=lambda r: r["_blk"])
    shape, params = shapes[rows[0]["model"]], np.array(rows[0]["at"])
    return rows, shape, params, carried([_unbytes(r["sums"]) for r in rows], shape, params)


def fit_arima_grid(df: DataFrame, by: Sequence[str], pos: str, y: str, orders: Sequence[Order], exog: Sequence[str] = (),
                   const: bool | None = None, long_ar: int = LONG_AR, rounds: int = ROUNDS,
                   block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """all orders (with the same d) at once.  Returns (models,
    blocks): ``by..., model`` (place in ``orders``), ``params`` (constant if
    any, AR, regressors, MA), ``sse``, ``n``, ``shocks`` (the last q) and
    ``first_sse`` (at the starting values)."""
    by, d = list(by), orders[0][1]
    if any(o[1] != d for o in orders):
        raise ValueError("the orders of one grid share d")
    shapes = [Shape(p, q, len(exog), d == 0 if const is None else const) for p, _, q in orders]
    halo = max(long_ar, max(s.p for s in shapes)) + max(s.q for s in shapes)
    blocks = cut_lineage(_packed(df, by, pos, y, exog, d, halo, block_rows))
    key = _fields(blocks, by)
    starts = _starting_values(blocks, by, shapes, d, len(exog), long_ar)
    nothing = F.array().cast("array<double>")
    state = starts.select(*by, F.posexplode("starts").alias("model", "trial")).select(
        *by, "model", "trial", F.col("trial").alias("best"), F.lit(float("inf")).alias("sse"), nothing.alias("jtj"), nothing.alias("jte"),
        F.lit(0).cast("long").alias("n"), nothing.alias("shocks"), F.lit(0.0).alias("damping"), F.lit(0).alias("failed"),
        F.lit(False).alias("done"), F.lit(None).cast("double").alias("first_sse"))
    state, path = written(state)

    names = [f.name for f in T._parse_datatype_string(STATE).fields]

    def settle(rows):
        _, _, _, (sse, jtj, jte, n, shocks, _) = _in_order(rows, shapes)
        yield (*[rows[0][b] for b in by], rows[0]["model"], sse, jtj.reshape(-1).tolist(), jte.tolist(), n, shocks.tolist())

    def step(row):
        shape = shapes[row["model"]]
        if not row["done"] and row["t_sse"] is not None:
            first = row["first_sse"] is None
            better = math.isfinite(row["t_sse"]) and row["t_sse"] < row["sse"]
            if better:
                gain = (row["sse"] - row["t_sse"]) / row["t_sse"] if math.isfinite(row["sse"]) and row["t_sse"] > 0 else math.inf
                row |= {"best": row["trial"], "sse": row["t_sse"], "jtj": row["t_jtj"], "jte": row["t_jte"], "n": row["t_n"],
                        "shocks": row["t_shocks"], "damping": row["damping"] / 10 if row["damping"] > 1e-6 else 0.0, "failed": 0}
                row["done"] = gain < SETTLED or row["sse"] == 0
            else:
                row |= {"damping": max(1e-3, 10 * row["damping"]), "failed": row["failed"] + 1}
                row["done"] = row["failed"] > 8 or not math.isfinite(row["sse"])
            if first:
                row["first_sse"] = row["t_sse"]
            if not row["done"]:
                jtj = np.array(row["jtj"]).reshape(shape.size, shape.size)
                row["trial"] = damped_step(jtj, np.array(row["jte"]), np.array(row["best"]), shape, row["damping"]).tolist()
        yield (*[row[b] for b in by], *[row[c] for c in names])

    for _ in range(rounds):
        open_ = state.where(~F.col("done"))
        sums = _sums_at(blocks, open_.select(*by, "model", F.col("trial").alias("at")), by, shapes, d, len(exog))
        found = _group_pass(sums, [*by, "model"], _like(key, "model int, t_sse double, t_jtj array<double>, t_jte array<double>, "
                                                             "t_n long, t_shocks array<double>"), settle)
        before = path
        state, path = written(_row_pass(null_safe_join(state, found, [*by, "model"], "left"), _like(key, STATE), step))
        remove_written(df.sparkSession, before)
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select(*by, "model", F.col("best").alias("params"), "sse", "n", "shocks", "first_sse"), blocks


def arima_terms(models: DataFrame, by: Sequence[str], orders: Sequence[Order], exog: Sequence[str] = (), const: bool | None = None) -> DataFrame:
    """Fitted numbers in long form: ``by..., order, term, coef`` with the terms
    ``const``, ``ar_L1``, ..., regressors, ``ma_L1``, ..., ``_sse``, ``_n``,
    ``_sigma2``, ``_k``."""
    parts = None
    for i, (p, d, q) in enumerate(orders):
        c = d == 0 if const is None else const
        terms = [*(["const"] if c else []), *[f"ar_L{k}" for k in range(1, p + 1)], *exog, *[f"ma_L{k}" for k in range(1, q + 1)]]
        pairs = [F.struct(F.lit(t).alias("term"), F.col("params")[j].alias("coef")) for j, t in enumerate(terms)]
        size = F.lit(float(len(terms) + 1))
        pairs += [F.struct(F.lit(t).alias("term"), v.cast("double").alias("coef")) for t, v in
                  (("_sse", F.col("sse")), ("_n", F.col("n")), ("_sigma2", F.col("sse") / F.col("n")), ("_k", size))]
        one = models.where(F.col("model") == i).select(*by, F.lit(str((p, d, q))).alias("order"), F.inline(F.array(*pairs)))
        parts = one if parts is None else parts.unionAll(one)
    return parts


def arima_residuals(models: DataFrame, blocks: DataFrame, by: Sequence[str], pos: str, orders: Sequence[Order], exog: Sequence[str] = (),
                    const: bool | None = None) -> DataFrame:
    """``by..., order, pos, residual``, the fitted shock of every whole
    row: each block is replayed from the state carried to it."""
    by, d = list(by), orders[0][1]
    shapes = [Shape(p, q, len(exog), d == 0 if const is None else const) for p, _, q in orders]
    key = _fields(blocks, by)
    sums = _sums_at(blocks, models.select(*by, "model", F.col("params").alias("at")), by, shapes, d, len(exog))

    def states(rows):
        rows, _, params, (*_, starts) = _in_order(rows, shapes)
        for r, s in zip(rows, starts):
            yield (*[r[b] for b in by], r["_blk"], r["model"], params.tolist(), s.tolist())

    spec = _like(key, "_blk long, model int, params array<double>, state array<double>")
    begun = _group_pass(sums, [*by, "model"], spec, states).groupBy(*by, "_blk").agg(
        F.collect_list(F.struct("model", "params", "state")).alias("models"))

    def replay(row):
        b = _block(row, 1 + len(exog))
        for m in row["models"]:
            shape, params, state = shapes[m["model"]], np.array(m["params"]), np.array(m["state"])
            theta, (x, whole) = params[shape.linear:], b.columns(shape, d)
            z = x[:, 0] - x[:, 1:] @ params[:shape.linear]
            for t in range(min(len(z), shape.q)):
                z[t] -= theta[t:] @ state[:shape.q - t]
            e = shock_filter(theta, z[:, None])[:, 0]
            for i in np.flatnonzero(whole):
                yield (*[row[c] for c in by], str(tuple(orders[m["model"]])), b.first + int(i), float(e[i]))

    return _row_pass(null_safe_join(blocks, begun, [*by, "_blk"]), _like(key, f"order string, `{pos}` long, residual double"), replay)


# -- forecasts --------------------------------------------------------------------

def psi_weights(phi: np.ndarray, theta: np.ndarray, d: int, h: int) -> np.ndarray:
    """Weights of past shocks in the level: ``theta(B) / (phi(B) (1 - B)^d)``."""
    ar = np.array([1.0, *(-phi)])
    for _ in range(d):
        ar = np.convolve(ar, [1.0, -1.0])
    psi = np.zeros(h)
    for j in range(h):
        psi[j] = 1.0 if j == 0 else theta[j - 1] if j <= len(theta) else 0.0
        for i in range(1, min(j, len(ar) - 1) + 1):
            psi[j] -= ar[i] * psi[j - i]
    return psi


def forecast_arima(df: DataFrame, models: DataFrame, by: Sequence[str], pos: str, y: str, orders: Sequence[Order],
                   future: DataFrame | None = None, h: int = 30, exog: Sequence[str] = (), const: bool | None = None,
                   level: float = 0.95) -> DataFrame:
    """``by..., order, pos, forecast, lower, upper`` for the ``h`` rows
    after each series' end, or the rows of ``future`` (with their regressors).
    Reads the last d + p rows of a series and its last shocks only."""
    by, exog = list(by), list(exog)
    key = _fields(df, by)
    keep = max(p + d for p, d, _ in orders) + 1
    n = series_lengths(df, by, pos)
    cells = F.struct(F.col(pos).cast("long").alias("t"), F.col(y).cast("double").alias("y"),
                     F.array(*[F.col(e).cast("double") for e in exog]).cast("array<double>").alias("x"))
    tail = (null_safe_join(df, n, by).where(F.col(pos) > F.col("_len") - keep).groupBy(*by)
            .agg(F.sort_array(F.collect_list(cells)).alias("tail")))  # keep rows a series
    if future is None:
        ahead = n.select(*by, F.transform(F.sequence(F.col("_len") + 1, F.col("_len") + h), lambda t: F.struct(
            t.cast("long").alias("t"), F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("x"))).alias("ahead"))
    else:
        ahead = future.withColumn(y, F.lit(None).cast("double")).groupBy(*by).agg(F.sort_array(F.collect_list(cells)).alias("ahead"))
    small = models.groupBy(*by).agg(F.collect_list(F.struct("model", "params", "sse", "n", "shocks")).alias("models"))
    rows = null_safe_join(null_safe_join(tail, ahead, by), small, by)
    z = NormalDist().inv_cdf(0.5 + level / 2)

    def of(row):
        past_y = [c["y"] for c in row["tail"]]
        past_x = np.array([c["x"] for c in row["tail"]], dtype=float).reshape(len(past_y), len(exog))
        next_x = np.array([c["x"] for c in row["ahead"]], dtype=float).reshape(len(row["ahead"]), -1)[:, :len(exog)]
        for m in row["models"]:
            p, d, q = orders[m["model"]]
            shape = Shape(p, q, len(exog), d == 0 if const is None else const)
            params = np.array(m["params"])
            c = int(shape.const)
            phi, beta, theta = params[c:c + p], params[c + p:shape.linear], params[shape.linear:]
            levels, w = list(past_y), list(np.diff(np.array(past_y, dtype=float), n=d))
            dx = np.diff(np.concatenate((past_x, next_x)), n=d, axis=0)[-len(next_x):] if exog else np.zeros((len(next_x), 0))
            shocks = list(m["shocks"])
            psi = psi_weights(phi, theta, d, len(row["ahead"]))
            spread = z * np.sqrt(m["sse"] / max(m["n"], 1) * np.cumsum(psi * psi))
            for j, cell in enumerate(row["ahead"]):
                v = (params[0] if c else 0.0) + sum(f * w[-k] for k, f in enumerate(phi, 1)) + float(beta @ dx[j])
                v += sum(f * s for f, s in zip(theta, shocks))
                shocks = [0.0, *shocks[:-1]] if shocks else []
                w.append(v)
                levels.append(v - sum((-1) ** i * math.comb(d, i) * levels[-i] for i in range(1, d + 1)))
                yield (*[row[b] for b in by], str(tuple(orders[m["model"]])), cell["t"], levels[-1], levels[-1] - spread[j], levels[-1] + spread[j])

    return _row_pass(rows, _like(key, f"order string, `{pos}` long, forecast double, lower double, upper double"), of)


def forecast_backtest(df: DataFrame, by: Sequence[str], pos: str, y: str, orders: Sequence[Order], exog: Sequence[str] = (),
                      h: int = 30, const: bool | None = None) -> DataFrame:
    """per order, fit on all but the last ``h`` rows of each series,
    forecast them with their known regressors: ``by..., order, rmse, aic,
    bic`` (Gaussian, from the conditional sum of squares)."""
    by = list(by)
    df = cut_lineage(df.select(*by, pos, y, *exog))  # fit, forecast and hold-out read it
    j = null_safe_join(df, series_lengths(df, by, pos), by)
    train = j.where(F.col(pos) <= F.col("_len") - h).drop("_len")
    test = j.where(F.col(pos) > F.col("_len") - h).drop("_len")
    models, _ = fit_arima_grid(train, by, pos, y, orders, exog, const)
    ahead = forecast_arima(train, models, by, pos, y, orders, test.select(*by, pos, *exog), h, exog, const)
    error = null_safe_join(ahead, test.select(*by, F.col(pos).cast("long").alias(pos), F.col(y).alias("_actual")), [*by, pos])
    rmse = error.groupBy(*by, "order").agg(F.sqrt(F.avg(F.pow(F.col("forecast") - F.col("_actual"), 2))).alias("rmse"))
    wide = arima_terms(models, by, orders, exog, const).groupBy(*by, "order").agg(
        *[F.max(F.when(F.col("term") == t, F.col("coef"))).alias(t) for t in ("_sse", "_n", "_k")])
    ll = -F.col("_n") / 2 * (F.log(2 * math.pi * F.col("_sse") / F.col("_n")) + 1)
    fit = wide.select(*by, "order", (2 * F.col("_k") - 2 * ll).alias("aic"), (F.col("_k") * F.log("_n") - 2 * ll).alias("bic"))
    return null_safe_join(rmse, fit, [*by, "order"])
