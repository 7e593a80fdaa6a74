"""Document fingerprints from prefix polynomial hashes.

With ``S[k]`` the sum over the first k code points c of ``(c + 1) * B^i`` modulo
the Mersenne prime 2^31 - 1, the hash of any span is a difference of two
entries times an inverse power, so one pass over a text answers every question
about equal spans, and the longest common extension of two places is found by
bisection (``PrefixHashes``).  A fingerprint is made of span hashes:

* two hashes of the whole text under different bases, and its length;
* a sketch: the smallest hash in each of ``BINS`` classes of all spans of
  ``WINDOW`` code points (one byte each);
* two ladders: hashes of the first and of the last r code points, for r = 16,
  23, 32, ... up to the length (two bytes each).

The likeness of two fingerprints is the greater of the share of spans in common
that the sketches show, and the share of the longer text that is certain to be
a common beginning or ending, found by bisection on the ladders.

``edit_with_next`` puts the documents in order of descending id by a range
partitioning and walks each partition once, a row at a time with the row behind
it.  Only the last row of a partition waits for the first of the next one: both
leave their texts in the checkpointed result, and a join of one row per
partition settles them.  Texts of more than ``PIECE`` code points are hashed in
pieces.

Results in special cases: a null text is an empty one (length 0, likeness 1 to
another empty text, 0 to any other); a null id comes last; rows that share an id
follow each other by a hash of their texts, equal rows in any order; a single
row is its own next one; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K
from pricewise.llm.registry import register, table
from pricewise.session import cut_lineage

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 747_796_405)
WINDOW = 24
BINS = 64
PIECE = 1 << 16            # code points hashed at a time
RUNGS = [round(16 * 2 ** (k / 2)) for k in range(64)]
HEAD = 16                  # bytes before the sketch: two hashes of 4 bytes, length of 8

_P, _31 = np.uint64(PRIME), np.uint64(31)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def partly(x: np.ndarray) -> np.ndarray:
    """A number congruent to ``x``, under 2^31 + x / 2^31."""
    return (x & _P) + (x >> _31)


def fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = np.atleast_1d(partly(partly(x)))
    return np.minimum(x, x - _P)  # x - prime wraps to a large number if x is less


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo the prime for i < n, doubled up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        made = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < n:
                p = np.concatenate((p, fold(p * np.uint64(pow(b, len(p), PRIME)))))
            made.append(p)
        have = _powers[base] = (made[0], made[1])
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHashes:
    """Prefix hashes of one array of code points."""

    def __init__(self, points: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(points) + 1)
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        # terms stay under 2^32, so that sums of 2^30 of them stay under 2^62
        np.cumsum(partly((points.astype(np.uint64) + np.uint64(1)) * up[:len(points)]), out=self.sums[1:])

    def span(self, start, end):
        """Hash of the code points from ``start`` to before ``end``."""
        return fold(partly(self.sums[end] - self.sums[start]) * self.down[start])

    def equal(self, i: int, j: int, n: int) -> bool:
        return bool(self.span(i, i + n)[0] == self.span(j, j + n)[0])


def common_extension(one: PrefixHashes, i: int, other: PrefixHashes, j: int) -> int:
    """Length of the longest common extension of place i and place j."""
    lo, hi = 0, min(len(one.sums) - 1 - i, len(other.sums) - 1 - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if one.span(i, i + mid)[0] == other.span(j, j + mid)[0] else (lo, mid - 1)
    return lo


def common_beginnings(one: pa.Array, other: pa.Array) -> pa.Array:
    """Code points that two texts have in common at their beginnings."""
    found = []
    for a, b in zip(one, other):
        a, b = (PrefixHashes(code_points(x.as_py() or "")) for x in (a, b))
        found.append(common_extension(a, 0, b, 0))
    return pa.array(found, pa.int64())


def _spread(h: np.ndarray) -> np.ndarray:
    """Span hashes with their bits spread over 64."""
    return K.mix(h + np.uint64(0x9E3779B97F4A7C15))


class _Sketch:
    """Smallest spread hash in every class, for several texts at once."""

    def __init__(self, n: int):
        self.least = np.full(n * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)

    def add(self, of: np.ndarray, h: np.ndarray) -> None:
        x = _spread(h)
        np.minimum.at(self.least, of * BINS + (x >> np.uint64(58)).astype(np.int64), x << np.uint64(6))

    def bytes(self) -> np.ndarray:
        """One byte per class, 0 where the class is empty."""
        code = (K.mix(self.least) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        return np.where(self.least == np.iinfo(np.uint64).max, np.uint8(0), code).reshape(-1, BINS)


def _packed(n: int, whole: Sequence[int], sketch: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    head = b"".join(int(w).to_bytes(4, "big") for w in whole) + n.to_bytes(8, "big")
    return head + sketch.tobytes() + begin.astype(">u2").tobytes() + end.astype(">u2").tobytes()


def _short(rungs: np.ndarray) -> np.ndarray:
    return _spread(rungs) >> np.uint64(48)


def _of_block(points: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Fingerprints of short texts laid end to end."""
    n = np.diff(offs)
    first = PrefixHashes(points)
    second = PrefixHashes(points, BASES[1])
    whole = [p.span(offs[:-1], offs[1:]).tolist() for p in (first, second)]
    sketch = _Sketch(len(n))
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(points))
    start = place[place + WINDOW <= offs[1:][of]]
    sketch.add(of[start], first.span(start, start + WINDOW))
    small = np.flatnonzero((n > 0) & (n < WINDOW))
    sketch.add(small, first.span(offs[small], offs[small] + n[small]))
    rows = sketch.bytes()
    steps = np.array(RUNGS)
    count = np.searchsorted(steps, n, "right")
    text = np.repeat(np.arange(len(n)), count)
    edge = np.cumsum(count)
    r = steps[np.arange(len(text)) - np.repeat(edge - count, count)]
    begin = _short(first.span(offs[text], offs[text] + r))
    end = _short(first.span(offs[text + 1] - r, offs[text + 1]))
    return [_packed(int(n[i]), (whole[0][i], whole[1][i]), rows[i], begin[edge[i] - count[i]:edge[i]], end[edge[i] - count[i]:edge[i]])
            for i in range(len(n))]


def _of_long(points: np.ndarray) -> bytes:
    """Fingerprint of one long text, piece by piece."""
    n = len(points)
    r = np.array([x for x in RUNGS if x <= n])
    marks = np.concatenate((r, n - r))  # prefixes whose hashes are asked for
    at = np.zeros(len(marks), dtype=np.uint64)
    sketch, totals = _Sketch(1), [0, 0]
    for lo in range(0, n, PIECE):
        size = min(PIECE, n - lo)
        piece = points[lo:lo + size + WINDOW - 1]
        for k, base in enumerate(BASES):
            hashes, lift = PrefixHashes(piece, base), pow(base, lo, PRIME)
            if k == 0:
                start = np.arange(min(size, len(piece) - WINDOW + 1))
                sketch.add(np.zeros(len(start), dtype=np.int64), hashes.span(start, start + WINDOW))
                here = np.flatnonzero((marks > lo) & (marks <= lo + size))
                local = fold(hashes.sums[marks[here] - lo])
                at[here] = fold(fold(local * np.uint64(lift)) + np.uint64(totals[0]))
            totals[k] = (totals[k] + int(hashes.sums[size]) % PRIME * lift) % PRIME
    down = np.array([pow(BASES[0], -int(x), PRIME) for x in n - r], dtype=np.uint64)
    end = fold(fold(np.uint64(totals[0] + PRIME) - at[len(r):]) * down)
    return _packed(n, totals, sketch.bytes()[0], _short(at[:len(r)]), _short(end))


def fingerprints(texts: Sequence[np.ndarray]) -> list[bytes]:
    """Fingerprint of every array of code points."""
    out, group, size = [], [], 0

    def flush():
        nonlocal group, size
        if group:
            offs = np.concatenate(([0], np.cumsum([len(g) for g in group])))
            out.extend(_of_block(np.concatenate(group), offs))
        group, size = [], 0

    for points in texts:
        if len(points) > PIECE:
            flush()
            out.append(_of_long(points))
            continue
        if size + len(points) > PIECE:
            flush()
        group.append(points)
        size += len(points)
    flush()
    return out


def _rungs_shared(a: bytes, b: bytes) -> int:
    """Length of the highest common rung of two ladders, by bisection."""
    lo, hi = 0, min(len(a), len(b)) // 2
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[2 * mid - 2:2 * mid] == b[2 * mid - 2:2 * mid] else (lo, mid - 1)
    return RUNGS[lo - 1] if lo else 0


def likeness(a: bytes, b: bytes) -> float:
    """Likeness of two packed fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    n, m = (int.from_bytes(x[8:HEAD], "big") for x in (a, b))
    if not n or not m:
        return 0.0
    one, two = (np.frombuffer(x, dtype=np.uint8, count=BINS, offset=HEAD) for x in (a, b))
    used = int(np.count_nonzero(one | two))
    alike = int(np.count_nonzero((one == two) & (one > 0))) / used
    alike = max(0.0, (alike - 1 / 255) / (1 - 1 / 255))  # bytes that agree by chance
    ladders = []
    for x in (a, b):
        rest = x[HEAD + BINS:]
        ladders.append((rest[:len(rest) // 2], rest[len(rest) // 2:]))
    (begin, end), (begin2, end2) = ladders
    ends = min(_rungs_shared(begin, begin2) + _rungs_shared(end, end2), n, m)
    return max(alike, ends / max(n, m))


def _digests(texts: pa.Array) -> pa.Array:
    found: list[str | None] = []
    data, offs = K.buffers(texts)
    for lo, hi, _, _ in K.blocks(data, offs):
        found += [f.hex() for f in fingerprints([code_points(t.as_py() or "") for t in texts.slice(lo, hi - lo)])]
    return pa.array(found, pa.string())


def fingerprint(text):
    """Column function: the fingerprint of a text, in lowercase hex."""
    return F.arrow_udf(_digests, "string")(F.coalesce(text.cast("string"), F.lit("")))


def fingerprint_likeness(one, other):
    """Column function: likeness of two fingerprints in hex; null if one is."""
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else likeness(bytes.fromhex(x), bytes.fromhex(y))
                         for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())
    return F.arrow_udf(of, "double")(one, other)


def beginning_in_common(one, other):
    """Column function: code points in common at the beginnings of two texts."""
    return F.arrow_udf(common_beginnings, "long")(one, other)


# -- documents and the next ones ---------------------------------------------

DONE, LAST, FIRST = 0, 1, 2
PAIR = ("n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double")


def edited(text, following):
    """The last half of ``text`` replaced by as much of ``following`` (strings
    or arrays of code points)."""
    half = len(text) // 2
    head, tail = text[:len(text) - half], following[:half]
    return head + tail if isinstance(text, str) else np.concatenate((head, tail))


def _pairs(texts: list[str], prints: list[bytes], points: list[np.ndarray],
           following: list[tuple[str, bytes, np.ndarray]]) -> list[tuple]:
    """The columns of ``PAIR`` for texts and the ones that follow them."""
    changed = fingerprints([edited(p, f[2]) for p, f in zip(points, following)])
    return [(len(p), hashlib.sha256(edited(t, f[0]).encode("utf-8", "surrogatepass")).digest(), own, new, likeness(own, new), likeness(own, f[1]))
            for t, own, p, f, new in zip(texts, prints, points, following, changed)]


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = None  # the row before: id, text, fingerprint, code points
    for batch in batches:
        texts = batch.column(1)
        data, offs = K.buffers(texts)
        for lo, hi, _, _ in K.blocks(data, offs):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            words = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
            points = [code_points(t) for t in words]
            rows = list(zip(ids, words, fingerprints(points), points))
            out = []
            if held is None:
                out.append((FIRST, rows[0][0], rows[0][1], len(rows[0][3]), None, rows[0][2], None, None, None))
            else:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) > 1:
                _, t, f, p = map(list, zip(*rows))
                made = _pairs(t[:-1], f[:-1], p[:-1], list(zip(t[1:], f[1:], p[1:])))
                out += [(DONE, r[0], None, *m) for r, m in zip(rows, made)]
            yield _batch(out, schema)
    if held is not None:
        yield _batch([(LAST, held[0], held[1], len(held[3]), None, held[2], None, None, None)], schema)


def _settle(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of last rows and the first rows behind them."""
    for batch in batches:
        for row in batch.to_pylist():
            mine, other = row["text"] or "", row["next_text"] or ""
            p, q = code_points(mine), code_points(other)
            yield _batch([(row["doc_id"], *_pairs([mine], [row["fingerprint"]], [p], [(other, row["next_fingerprint"], q)])[0])], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(id_type, *ahead) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema([*ahead, ("doc_id", to_arrow_type(id_type))])


def edit_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary),
    near_edited, near_next for every row, where its text is edited with that of
    the next row by descending id."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("at")]
    rows = (rows.withColumn("tie", F.xxhash64("text"))
            .withColumn("at", F.monotonically_increasing_id())  # parts equal rows too
            .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    id_field = _arrow(rows.schema["doc_id"].dataType)[0]
    pair = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
            ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    whole = pa.schema([("kind", pa.int32()), id_field, ("text", pa.string()), *pair])
    settled = pa.schema([id_field, *pair])
    kind = rows.schema["doc_id"].dataType.simpleString()
    walked = rows.mapInArrow(lambda b: _walk(b, whole), f"kind int, doc_id {kind}, text string, {PAIR}")
    # digests of every row, and two texts per partition
    walked = cut_lineage(walked.withColumn("part", F.spark_partition_id()))
    heads = walked.where(F.col("kind") == FIRST)
    # numbers of the partitions that have rows: as many as shuffle partitions
    in_order = Window.orderBy("part")
    parts = heads.select("part", F.coalesce(
        F.lead("part").over(in_order), F.first("part").over(in_order)).alias("next_part"))
    behind = heads.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                          F.col("fingerprint").alias("next_fingerprint"))
    last = (walked.where(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
            .join(parts, "part").join(behind, "next_part")
            .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"))
    ends = last.mapInArrow(lambda b: _settle(b, settled), f"doc_id {kind}, {PAIR}")
    return walked.where(F.col("kind") == DONE).select(*ends.columns).unionAll(ends)


@register("op12_document_fingerprints")
def op12(spark, sf_dir):
    def hexed(c):
        return F.lower(F.hex(c)).alias(c)

    return edit_with_next(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"),
        "near_edited", "near_next")
