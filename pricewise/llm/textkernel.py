"""Vectorised UTF-8 word splitting and hashing over Arrow string columns.

All functions work on the bytes of a whole block of texts at once (no loop
over words).  A word hash is a polynomial over the word's bytes modulo 2^64
(taken from prefix sums), passed through a 64-bit finaliser; a window hash is
the same construction over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19  # texts worked on at a time, in bytes (at least one text)

KEPT_POWERS = 2 << 20

# Byte classes.  White space is [\x20\x09-\x0D]; a term byte is an ASCII
# letter or digit or any byte of a non-ASCII character.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[ord("0"):ord("9") + 1] = True
IS_TERM[ord("a"):ord("z") + 1] = True
IS_TERM[ord("A"):ord("Z") + 1] = True
IS_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_values(x: int = 0x243F6A8885A308D3) -> np.ndarray:
    """256 pseudo-random odd 64-bit values, from a fixed multiplicative rule."""
    out = []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) & _MASK
        y = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _MASK
        out.append((y ^ (y >> 29)) | 1)
    return np.array(out, dtype=np.uint64)


BYTE_VALUES = _byte_values()
CHECK_VALUES = _byte_values(0x13198A2E03707344)  # for a second, independent hash
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (kept for the largest n)."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inv = pow(_BASE, -1, 1 << 64)
        have = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))))
                     for b in (_BASE, inv))
        if size <= KEPT_POWERS:
            _powers[0] = have
    return have


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and U+00C0 to U+00DE (but U+00D7) lower-cased."""
    d = LOWER[data]
    at = np.flatnonzero(d[:-1] == 0xC3) + 1
    second = d[at]
    d[at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    return d


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def blocks(data: np.ndarray, offs: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``size`` bytes: first, last, bytes, offsets."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes inside each
    text, and the number of such runs before each text (length texts + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = member[data]
    before = np.empty(len(m) + 1, dtype=bool)
    before[0] = False
    before[1:] = m
    before[offs] = False
    after = np.empty(len(m) + 1, dtype=bool)
    after[:-1] = m
    after[-1] = False
    after[offs] = False
    starts = np.flatnonzero(m & ~before[:-1])
    ends = np.flatnonzero(m & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """One 64-bit hash per span of bytes; other byte ``values``, another hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes (over one long array;
    windows over a text's end are to be masked by the caller)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h))
    sums = np.empty(len(h) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(h * up[:len(h)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:len(h) - width + 1])


def in_text(word_offs: np.ndarray, width: int, n_windows: int) -> np.ndarray:
    """Which window starts have all their words inside one text."""
    ok = np.ones(n_windows, dtype=bool)
    for_last = word_offs[1:-1] if len(word_offs) > 2 else word_offs[:0]
    if len(for_last):
        bad = np.zeros(n_windows + 1, dtype=np.int32)
        lo = np.clip(for_last - width + 1, 0, n_windows)
        hi = np.clip(for_last, 0, n_windows)
        np.add.at(bad, lo, 1)
        np.add.at(bad, hi, -1)
        ok = np.cumsum(bad[:-1]) == 0
    return ok


def covered(starts_mask: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Words covered by windows that begin where ``starts_mask`` holds."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    at = np.flatnonzero(starts_mask)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + width, n_words), 1)
    return np.cumsum(edge[:-1]) > 0


def text_words(column, lower: bool = False, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column and word offsets by text, worked
    out block by block (white-space words; A-Z lower-cased if asked)."""
    data, offs = buffers(column)
    parts, counts = [], [np.zeros(1, np.int64)]
    for _, _, d, o in blocks(data, offs):
        s, e, w = words(d, o)
        d = LOWER[d] if lower else d
        parts.append(word_hashes(d, s, e, values))
        counts.append(np.diff(w))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return h, np.cumsum(np.concatenate(counts))


def distinct_words(column, lower: bool = False, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of all texts of a column as sorted 64-bit keys with 64
    independent check bits each, every word's place among them, and word
    offsets by text.  Words are the same if all 128 bits are."""
    h, offs = text_words(column, lower)
    check, _ = text_words(column, lower, CHECK_VALUES)
    h = h >> np.uint64(64 - key_bits)
    values, first, place = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(check[first][place], check):  # two words under one key
        order = np.lexsort((check, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        values, first = h[order][new], order[new]
    return values, check[first], place, offs
