"""Byte-pair merges of many short symbol rows at once."""

from __future__ import annotations

import numpy as np

NEVER = np.iinfo(np.int32).max  # rank of a pair that doesn't merge


class PairTable:
    """Merge ranks by pair of ids (pairs are first << 32 | second): open
    addressing in flat arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray, bits: int = 18):
        self.bits = bits
        size = 1 << bits
        if 2 * len(pairs) > size:
            raise ValueError("the table is too small for these pairs")
        self.key = np.full(size, -1, dtype=np.int64)  # -1: free
        self.rank = np.full(size, NEVER, dtype=np.int32)
        self.made = np.full(size, -1, dtype=np.int32)
        self.insert(pairs, ranks, made)

    def insert(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """Add distinct new pairs."""
        left, size = np.arange(len(pairs)), len(self.key)
        slot = self.slots(pairs)
        while len(left):
            free = self.key[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            who = left[free][first]
            self.key[at], self.rank[at], self.made[at] = pairs[who], ranks[who], made[who]
            rest = ~np.isin(left, who)
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair; a slot of rank NEVER if it doesn't merge."""
        return self.find_keys(a.astype(np.int64) << 32 | b.astype(np.int64))

    def find_keys(self, pairs: np.ndarray) -> np.ndarray:
        slot = self.slots(pairs)
        at = np.flatnonzero((self.key[slot] != pairs) & (self.key[slot] >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            at = at[(self.key[slot[at]] != pairs[at]) & (self.key[slot[at]] >= 0)]
        return slot


def merge_rows(ids: np.ndarray, lens: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row's first ``lens`` symbols to the end: lowest rank first,
    leftmost among equals, one merge per row and round.  Returns the rows'
    symbols (places after a row's new length are void) and new lengths."""
    width = ids.shape[1]
    cols = np.arange(width)
    done, n, rows = ids.copy(), lens.copy(), np.arange(len(ids))
    rank = np.full(ids.shape, NEVER, dtype=np.int32)
    r, c = np.nonzero(cols[:-1] < lens[:, None] - 1)
    rank[r, c] = table.rank[table.find(ids[r, c], ids[r, c + 1])]
    while len(rows):
        j = rank.argmin(axis=1)
        go = rank[np.arange(len(rows)), j] != NEVER
        if not go.all():
            stop = rows[~go]
            done[stop, :ids.shape[1]] = ids[~go]
            rows, ids, rank, j = rows[go], ids[go], rank[go], j[go]
            if not len(rows):
                break
        k = np.arange(len(rows))
        new = table.made[table.find(ids[k, j], ids[k, j + 1])]
        keep = cols[:ids.shape[1] - 1] <= j[:, None]
        ids = np.where(keep, ids[:, :-1], ids[:, 1:])
        rank = np.where(keep, rank[:, :-1], rank[:, 1:])
        ids[k, j] = new
        n[rows] -= 1
        m = n[rows]
        for side in (-1, 0):  # the pairs to the left and right of the new symbol
            ok = (j + side >= 0) & (j + side + 1 < m)
            q = j[ok] + side
            rank[k[ok], q] = table.rank[table.find(ids[k[ok], q], ids[k[ok], q + 1])]
        last = j + 1 >= m
        rank[k[last], j[last]] = NEVER
    return done, n
