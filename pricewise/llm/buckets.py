"""Corpus-wide questions about 64-bit values, asked slice by slice.

Documents are dealt to *slices* (a few MB of text each, by a hash of the
row); a slice sends its distinct values, sorted and packed, to *buckets*
(ranges of the value space), a bucket answers for every value it was sent,
and the answers travel back to the slice in the order it sent them.  A value
that a third of all rows share is sent once per slice, so no bucket depends
on how often a value occurs.

A slice numbers its rows by (doc_id, text), so its values come out alike in
every pass, whatever order the shuffle delivers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20      # text of one slice
BUCKET_VALUES = 1 << 20    # values a bucket is planned to be sent

SENT_SCHEMA = "bucket int, slice int, n long, packed binary, extra binary"


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the whole table (one scan of the text's lengths)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def plan_sizes(n_bytes: int, slice_bytes: int = SLICE_BYTES, bucket_values: int = BUCKET_VALUES,
               bytes_per_value: float = 6.0) -> tuple[int, int]:
    """Numbers of slices and buckets for so much text; both grow with it."""
    return (max(1, -(-n_bytes // slice_bytes)),
            max(1, int(n_bytes / bytes_per_value / bucket_values) + 1))


def into_slices(docs: DataFrame, n_slices: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a column slice, dealt by it.  A row's
    slice is a hash of its id and text, so copies under different ids spread
    out."""
    return (docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slices)).cast("int").alias("slice"), "*")
            .repartition("slice"))


def in_order(rows: pa.Table) -> pa.Table:
    """The slice's rows by id, then text."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as the first value and the gaps, byte
    plane by byte plane (high planes are mostly zero and compress away)."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    first = int(gaps[0])
    gaps[0] = 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return first.to_bytes(8, "little") + bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    width = blob[8]
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(width, n).T
    gaps = wide.reshape(-1).view("<u8").astype(np.uint64)
    gaps[0] = int.from_bytes(blob[:8], "little")
    return np.cumsum(gaps, dtype=np.uint64)


def bucket_edges(sorted_values: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's range of values begins in a sorted array."""
    limits = [(i << bits) // n_buckets for i in range(1, n_buckets)]
    inner = np.searchsorted(sorted_values, np.array(limits, dtype=np.uint64))
    return np.concatenate(([0], inner, [len(sorted_values)])).astype(np.int64)


def sent(slice_id: int, values: np.ndarray, extra: np.ndarray, n_buckets: int, bits: int = 64,
         check: np.ndarray | None = None) -> pa.Table:
    """A slice's rows to the buckets.  ``extra`` is any array beside the
    sorted values; boolean arrays travel as bits.  ``check`` has 64 further
    bits of every value, behind it."""
    out = {"bucket": [], "slice": [], "n": [], "packed": [], "extra": []}
    edges = bucket_edges(values, n_buckets, bits)
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        part = extra[lo:hi]
        out["bucket"].append(int(b))
        out["slice"].append(slice_id)
        out["n"].append(int(hi - lo))
        out["packed"].append(pack(values[lo:hi]))
        own = (np.packbits(part) if part.dtype == bool else part).tobytes()
        out["extra"].append(own if check is None else own + check[lo:hi].astype("<u8").tobytes())
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("n", pa.int64()),
                                           ("packed", pa.binary()), ("extra", pa.binary())]))


def bits_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)


ANSWER_SCHEMA = "slice int, bucket int, kind int, packed binary"


def answers(rows: pa.Table, parts: list[bytes], kind: int) -> pa.Table:
    return pa.table({"slice": rows["slice"], "bucket": rows["bucket"],
                     "kind": pa.array([kind] * len(rows), pa.int32()), "packed": pa.array(parts, pa.binary())},
                    schema=pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()),
                                      ("packed", pa.binary())]))


def answer_bits(rows: pa.Table, kind: int, values: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """The answers of one kind for a slice's sorted values, as booleans."""
    out = np.zeros(len(values), dtype=bool)
    edges = bucket_edges(values, n_buckets, bits)
    for b, k, blob in zip(rows["bucket"].to_pylist(), rows["kind"].to_pylist(), rows["packed"].to_pylist()):
        if k == kind:
            out[edges[b]:edges[b + 1]] = bits_of(blob, int(edges[b + 1] - edges[b]))
    return out


def seen_twice(rows: pa.Table, flag_bits: int, kind: int, checked: bool = False) -> pa.Table:
    """Bucket step: a value's answer is true if two places hold it (two
    slices, or one slice that says so in its first flag) and, with a second
    flag, if that flag is set anywhere.  ``checked`` values are the same only
    if their further 64 bits agree too."""
    n = np.array(rows["n"].to_pylist(), dtype=np.int64)
    values = [unpack(p, k) for p, k in zip(rows["packed"].to_pylist(), n)]
    flags = [bits_of(x, int(k) * flag_bits).reshape(flag_bits, int(k)) if flag_bits == 1 else
             np.concatenate([bits_of(x[:(int(k) + 7) // 8], int(k)), bits_of(x[(int(k) + 7) // 8:], int(k))]).reshape(2, int(k))
             for x, k in zip(rows["extra"].to_pylist(), n)]
    v = np.concatenate(values)
    f = np.concatenate(flags, axis=1)
    if checked:
        c = np.concatenate([np.frombuffer(x, "<u8", offset=(int(k) + 7) // 8) for x, k in zip(rows["extra"].to_pylist(), n)])
        order = np.lexsort((c, v))
        first = np.concatenate(([True], (np.diff(v[order]) != 0) | (np.diff(c[order]) != 0)))
    else:
        order = np.argsort(v, kind="stable")
        first = np.concatenate(([True], np.diff(v[order]) != 0))
    s = v[order]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(s)))
    good = (count >= 2) | np.logical_or.reduceat(f[0][order], at)
    if flag_bits == 2:
        good &= np.logical_or.reduceat(f[1][order], at)
    back = np.empty(len(s), dtype=bool)
    back[order] = np.repeat(good, count)
    ends = np.cumsum(n)
    return answers(rows, [np.packbits(back[e - k:e]).tobytes() for e, k in zip(ends, n)], kind)
