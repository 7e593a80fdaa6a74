"""Prediction by partial matching over byte contexts, with frozen counts.

A model is a variable-order trie of byte contexts up to ``ORDER`` bytes: all
contexts of order 0 to 2 that occur, and those of order 3.  A ``Trie`` holds
all of these; ``LowerOrders`` holds none of order 3 and gives the code lengths
under any of them whose counts are brought to it, so a model can have all
contexts without being in one place.  A symbol's probability starts at the
longest context in the trie.  If it was seen there, it has count / (total + kinds).  If not, the coder escapes
with kinds / (total + kinds), goes to the context one byte shorter and leaves
out the symbols already refused (symbol exclusion).  Below order 0 the symbols
left are equally likely.  A context in which every symbol is known keeps no
escape share, so probabilities always add up to 1.

With frozen counts the code length of every (context, symbol) is fixed, so the
trie is compiled into one table of code lengths, and scoring a text is a
look-up per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K

ORDER = 3
PAD = 0x0A  # what stands before a text's first byte
SCATTER = 0x9E3779  # odd: a one-to-one product modulo 2^24


def contexts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every byte the three bytes before it in its text, as 24 bits."""
    n = len(data)
    out = np.zeros(n, dtype=np.uint32)
    for back in range(1, ORDER + 1):
        prev = np.full(n, PAD, dtype=np.uint32)
        prev[back:] = data[:n - back] if back <= n else 0
        for i in range(back):  # places nearer to the text's start than ``back``
            at = offs[:-1] + i
            at = at[at < offs[1:]]
            prev[at] = PAD
        out |= prev << np.uint32(8 * (back - 1))
    return out


def gram_counts(docs: DataFrame, by: list[str], lower: bool) -> DataFrame:
    """(by..., gram, n): counts of every 4-byte string (three bytes of
    context and the byte) over the texts, added up in each batch first."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["gram long", "n long"])

    def run(batches):
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            if by:
                key = batch.column(by[0]).to_pylist()
                groups = sorted(set(key))
                group = np.array([groups.index(k) for k in key], dtype=np.uint64)
            held = []
            for lo, hi, d, o in K.blocks(data, offs):
                if lower:
                    d = K.LOWER[d]
                gram = contexts(d, o) << np.uint32(8) | d
                if by:
                    gram = gram.astype(np.uint64) | np.repeat(group[lo:hi] << np.uint64(32), np.diff(o))
                held.append(np.unique(gram, return_counts=True))
            if not held:
                continue
            gram, where = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            cols = [pa.array((gram & np.uint64(0xFFFFFFFF) if by else gram).astype(np.int64)), pa.array(n)]
            if by:
                cols.insert(0, pa.array(np.array(groups, dtype=object)[(gram >> np.uint64(32)).astype(np.int64)],
                                        batch.schema.field(by[0]).type))
            yield pa.record_batch(cols, names=[*by, "gram", "n"])

    return (docs.select(*by, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
            .groupBy(*by, "gram").agg(F.sum("n").alias("n")))


def gram_keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every byte its 4-byte string, with the three bytes of context
    scattered over 24 bits (one to one), so that ranges of keys are alike in
    size and a context's strings stay neighbours."""
    return (contexts(data, offs) * np.uint32(SCATTER) & np.uint32(0xFFFFFF)) << np.uint32(8) | data


@dataclass
class Trie:
    """Dense counts of one model by order: contexts (sorted) and counts."""
    keys: list[np.ndarray]    # per order 0..3
    counts: list[np.ndarray]  # per order, [contexts, 256]

    @staticmethod
    def build(low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray]) -> Trie:
        keys, counts = [], []
        for order in range(ORDER + 1):
            gram, n = (high if order == ORDER else low)
            gram = np.asarray(gram, dtype=np.int64) & ((1 << (8 * (order + 1))) - 1)
            ctx = np.unique(gram >> 8) if order else np.zeros(1, np.int64)
            table = np.zeros((len(ctx), 256))
            if len(gram):
                np.add.at(table, (np.searchsorted(ctx, gram >> 8), gram & 255), n)
            keys.append(ctx)
            counts.append(table)
        return Trie(keys, counts)

    @staticmethod
    def whole(gram: np.ndarray, n: np.ndarray) -> Trie:
        """A trie with every context of the counted 4-byte strings."""
        low, where = np.unique(gram & 0xFFFFFF, return_inverse=True)
        return Trie.build((low, np.bincount(where, weights=n, minlength=len(low))), (gram, n))

    def code_lengths(self) -> list[np.ndarray]:
        """-ln P(symbol | context) by order, [contexts, 256]."""
        return self.lengths_and_escapes()[0]

    def lengths_and_escapes(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The code lengths, and those after an escape from each context."""
        top, escapes, below = [], [], None
        for order in range(ORDER + 1):
            own = self.counts[order]
            if order == 0:
                left = 256 - (own > 0).sum()
                refused = np.full((1, 256), np.log(left) if left else 0.0)
            else:
                parent = np.searchsorted(self.keys[order - 1], self.keys[order] & ((1 << (8 * (order - 1))) - 1))
                refused = shorter(own > 0, self.counts[order - 1][parent], below[parent])
            top.append(shorter(np.zeros_like(own, dtype=bool), own, refused))
            escapes.append(refused)
            below = refused
        return top, escapes


def shorter(out: np.ndarray, counts: np.ndarray, refused: np.ndarray) -> np.ndarray:
    """Code lengths of symbols in a context with the symbols ``out`` excluded;
    ``refused`` has those after an escape from it."""
    seen = counts > 0
    left = np.where(out, 0, counts)
    total = left.sum(axis=1, keepdims=True)
    kinds = (left > 0).sum(axis=1, keepdims=True).astype(float)
    spare = np.where(seen.all(axis=1, keepdims=True), 0.0, kinds)  # nothing left to escape to
    with np.errstate(divide="ignore", invalid="ignore"):
        here = np.log(total + spare) - np.log(left)
        escape = np.where(kinds > 0, np.log(total + spare) - np.log(spare), 0.0)
        return np.where(seen & ~out, here, np.where(seen, 0.0, escape + refused))


class LowerOrders:
    """Orders 0 to 2 of one model, from the counts of all 3-byte strings (at
    most 2^24): what the code lengths of any order-3 context need beside its
    own counts."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = gram, n
        self._made = None

    def __getstate__(self):
        return {"gram": self.gram, "n": self.n, "_made": None}

    def made(self) -> tuple[Trie, list[np.ndarray], list[np.ndarray]]:
        if self._made is None:
            none = np.zeros(0, np.int64)
            trie = Trie.build((self.gram, self.n), (none, none))
            self._made = (trie, *trie.lengths_and_escapes())
        return self._made

    def code_lengths(self, context: np.ndarray, own: np.ndarray) -> np.ndarray:
        """-ln P(symbol | context) in order-3 contexts with the counts ``own``,
        [contexts, 256]; a context without counts acts as the longest shorter
        one that has some."""
        trie, top, escapes = self.made()
        out = np.repeat(top[0], len(context), axis=0)
        for order in (1, 2):
            short = context & ((1 << (8 * order)) - 1)
            keys = trie.keys[order]
            if len(keys):
                up = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                known = keys[up] == short
                out[known] = top[order][up[known]]
        learnt = own.any(axis=1)
        if learnt.any():
            own = own[learnt]
            parent = np.searchsorted(trie.keys[2], context[learnt] & 0xFFFF)
            refused = shorter(own > 0, trie.counts[2][parent], escapes[2][parent])
            out[learnt] = shorter(np.zeros_like(own, dtype=bool), own, refused)
        return out

    def gram_lengths(self, keys: np.ndarray, n: np.ndarray, step: int = 2048) -> np.ndarray:
        """Code lengths of sorted distinct ``gram_keys`` with these counts;
        all counted strings of a context must be among them."""
        out = np.zeros(len(keys))
        spread, symbol = (keys >> np.uint64(8)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        first = np.flatnonzero(np.diff(spread, prepend=-1))
        context = spread[first] * pow(SCATTER, -1, 1 << 24) & 0xFFFFFF
        row, edge = np.searchsorted(first, np.arange(len(keys)), "right") - 1, np.append(first, len(keys))
        for at in range(0, len(first), step):
            end = min(at + step, len(first))
            some = slice(edge[at], edge[end])
            own = np.zeros((end - at, 256))
            own[row[some] - at, symbol[some]] = n[some]
            out[some] = self.code_lengths(context[at:end], own)[row[some] - at, symbol[some]]
        return out


class Tables:
    """Several models over one set of contexts: scoring look-ups."""

    def __init__(self, tries: list[Trie]):
        self.keys = [np.unique(np.concatenate([t.keys[o] for t in tries])) for o in range(ORDER + 1)]
        lengths = [t.code_lengths() for t in tries]
        rows = sum(map(len, self.keys))
        table = np.empty((rows, 256, len(tries)), dtype=np.float32)
        for m, (trie, cost) in enumerate(zip(tries, lengths)):
            at, lower = 0, None
            for order, keys in enumerate(self.keys):
                if order == 0:
                    filled = np.repeat(cost[0], len(keys), axis=0)
                else:  # a context this model lacks acts as the next shorter one
                    up = np.searchsorted(self.keys[order - 1], keys & ((1 << (8 * (order - 1))) - 1))
                    filled = lower[up]
                    own = np.searchsorted(keys, trie.keys[order])
                    filled[own] = cost[order]
                table[at:at + len(keys), :, m] = filled
                at, lower = at + len(keys), filled
        self.table = table.reshape(-1, len(tries))
        self._node = None

    def __getstate__(self):
        return {"keys": self.keys, "table": self.table, "_node": None}

    def nodes(self) -> np.ndarray:
        """Row of the longest known context for all 2^24 contexts."""
        if self._node is None:
            node = np.zeros(1 << 24, dtype=np.uint16 if sum(map(len, self.keys)) < 1 << 16 else np.int32)
            k1, k2, k3 = self.keys[1:]
            wide = node.reshape(1 << 16, 256)
            wide[:, k1] = 1 + np.arange(len(k1))
            node.reshape(256, 1 << 16)[:, k2] = 1 + len(k1) + np.arange(len(k2))
            node[k3] = 1 + len(k1) + len(k2) + np.arange(len(k3))
            self._node = node
        return self._node

    def costs(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length in nats of every text under every model."""
        out = np.zeros((len(offs) - 1, self.table.shape[1]))
        full = np.flatnonzero(np.diff(offs) > 0)
        if len(full):
            at = self.nodes()[contexts(data, offs)].astype(np.int64) * 256 + data
            out[full] = np.add.reduceat(self.table[at], offs[:-1][full], axis=0, dtype=np.float64)
        return out


def by_hash(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(mod))
