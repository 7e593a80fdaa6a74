"""Substring dedup: repeated passages found by fixed-block anchors.

A repeated passage of at least ``width`` words holds a whole block of
``block = (width + 1) // 2`` words that starts at a multiple of ``block`` in
its own document.  Those non-overlapping blocks are the index.  Every rolling
window of ``block`` words of every document probes it; windows whose block
also occurs elsewhere are hits.  Hits are extended to maximal exact repeats:
each ``width``-word window around a hit is compared, corpus-wide, with the
others of the same content, and runs of repeated windows merge into spans,
which end where a repeat ends to either side.

Index, probes and windows travel as packed distinct values per slice of
documents (``buckets``), so a passage that a third of all documents share
costs one entry per slice.  Windows are compared by two independent 64-bit content
hashes (``textkernel``): two different windows agree in all 128 bits with
probability 2^-128 a pair.

Results in special cases: a null text has no words; a text of fewer than
``width`` words loses nothing; two rows with equal doc_id and equal text are
two documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm import buckets as B
from pricewise.llm import textkernel as K
from pricewise.llm.registry import register, table

WIDTH = 35
PROBE_BITS = 40  # of a probe's hash: collisions only add candidates, which full windows then refuse


class Repeats:
    """The same work on a slice in every pass, so that answers line up."""

    def __init__(self, width: int, n_buckets: int, key_bits: int = 64):
        self.width, self.block, self.n_buckets, self.key_bits = width, (width + 1) // 2, n_buckets, key_bits

    def probes(self, rows: pa.Table):
        """Word hashes, word offsets, distinct sorted probe values, and the
        windows' places among them (-1: over a text's end)."""
        h, offs = K.text_words(rows["text"])
        w = K.window_hashes(h, self.block) >> np.uint64(64 - PROBE_BITS)
        ok = K.in_text(offs, self.block, len(w))
        at = np.flatnonzero(ok)
        values, place, count = np.unique(w[at], return_inverse=True, return_counts=True)
        return h, offs, values, at, place, count

    def send_probes(self, rows: pa.Table) -> pa.Table:
        rows = B.in_order(rows)
        _, offs, values, at, place, count = self.probes(rows)
        if not len(values):
            return empty_sent()
        doc_start = np.repeat(offs[:-1], np.diff(offs))
        aligned = np.zeros(len(values), dtype=bool)
        aligned[place[(at - doc_start[at]) % self.block == 0]] = True
        return two_flags(rows["slice"][0].as_py(), values, count > 1, aligned, self.n_buckets)

    def candidates(self, rows: pa.Table, back: pa.Table):
        """Starts of the full windows around hits, and their distinct contents:
        sorted keys, check hashes, the windows' places among them, counts."""
        h, offs, values, at, place, _ = self.probes(rows)
        good = B.answer_bits(back, 0, values, self.n_buckets, PROBE_BITS)
        hits = np.zeros(len(h) + 1, dtype=np.int64)
        hits[1:][at[good[place]]] = 1
        sums = np.cumsum(hits)
        full = K.window_hashes(h, self.width)
        n = len(full)
        near = sums[np.minimum(np.arange(n) + self.width - self.block + 1, len(h))] - sums[:n] > 0
        start = np.flatnonzero(near & K.in_text(offs, self.width, n))
        again, _ = K.text_words(rows["text"], values=K.CHECK_VALUES)
        key, check = full[start] >> np.uint64(64 - self.key_bits), K.window_hashes(again, self.width)[start]
        order = np.lexsort((check, key))
        key, check = key[order], check[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (np.diff(key) != 0) | (np.diff(check) != 0)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(first) - 1
        return offs, start, key[first], check[first], place, np.bincount(place, minlength=int(first.sum()))

    def send_windows(self, rows: pa.Table, back: pa.Table) -> pa.Table:
        if not len(rows) or not len(back):
            return empty_sent()
        slice_id = rows["slice"][0].as_py()
        _, _, found, check, _, count = self.candidates(B.in_order(rows), back)
        return B.sent(slice_id, found, count > 1, self.n_buckets, self.key_bits, check) if len(found) else empty_sent()

    def spans(self, rows: pa.Table, back: pa.Table):
        """Covered words (a mask) and word offsets of a slice's rows."""
        offs, start, found, _, place, _ = self.candidates(rows, back)
        again = B.answer_bits(back, 1, found, self.n_buckets, self.key_bits)
        mask = np.zeros(int(offs[-1]), dtype=bool)
        mask[start[again[place]]] = True
        return K.covered(mask, self.width, len(mask)), offs


def two_flags(slice_id: int, values: np.ndarray, many: np.ndarray, aligned: np.ndarray, n_buckets: int) -> pa.Table:
    out = B.sent(slice_id, values, many, n_buckets, PROBE_BITS)
    more = B.sent(slice_id, values, aligned, n_buckets, PROBE_BITS)
    both = [a + b for a, b in zip(out["extra"].to_pylist(), more["extra"].to_pylist())]
    return out.set_column(4, "extra", pa.array(both, pa.binary()))


def empty_sent() -> pa.Table:
    return B.sent(0, np.zeros(0, np.uint64), np.zeros(0, bool), 1)


def _digest(rows: pa.Table, mask: np.ndarray, offs: np.ndarray) -> pa.Table:
    ids, n, gone, sha = rows["doc_id"], [], [], []
    for i, text in enumerate(rows["text"].to_pylist()):
        out = mask[offs[i]:offs[i + 1]]
        words = text.encode().split() if text else []
        kept = [w for w, x in zip(words, out.tolist()) if not x] if out.any() else words
        n.append(len(words))
        gone.append(len(words) - len(kept))
        sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table({"doc_id": ids.cast(pa.int64()), "n_words": pa.array(n, pa.int64()),
                     "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _cleaned(rows: pa.Table, mask: np.ndarray, offs: np.ndarray) -> pa.Table:
    texts = rows["text"].to_pylist()
    left = np.ones(len(texts), dtype=bool)
    hit = np.add.reduceat(np.append(mask, False), offs[:-1]) if len(texts) else offs[:0]
    for i in np.flatnonzero((np.diff(offs) > 0) & (hit > 0)).tolist():
        words = texts[i].encode().split()
        kept = [w for w, x in zip(words, mask[offs[i]:offs[i + 1]].tolist()) if not x]
        texts[i], left[i] = b" ".join(kept).decode(), bool(kept)
    out = pa.table({"doc_id": rows["doc_id"], "text": pa.array(texts, pa.string()), "rest": rows["rest"]})
    return out.filter(pa.array(left))


def _run(docs: DataFrame, width: int, finish, schema: str, key_bits: int = 64) -> DataFrame:
    n_slices, n_buckets = B.plan_sizes(B.text_bytes(docs))
    work = Repeats(width, n_buckets, key_bits)
    dealt = B.into_slices(docs, n_slices)  # one exchange of the text, reused by all three passes

    hits = (dealt.groupBy("slice").applyInArrow(lambda t: work.send_probes(t), B.SENT_SCHEMA)
            .groupBy("bucket").applyInArrow(lambda t: B.seen_twice(t, 2, 0), B.ANSWER_SCHEMA))
    again = (dealt.groupBy("slice").cogroup(hits.groupBy("slice"))
             .applyInArrow(lambda rows, back: work.send_windows(rows, back), B.SENT_SCHEMA)
             .groupBy("bucket").applyInArrow(lambda t: B.seen_twice(t, 1, 1, True), B.ANSWER_SCHEMA))

    def last(rows: pa.Table, back: pa.Table) -> pa.Table:
        if len(rows):
            rows = B.in_order(rows)
        mask, offs = work.spans(rows, back)
        return finish(rows, mask, offs)

    return (dealt.groupBy("slice").cogroup(hits.unionAll(again).groupBy("slice"))
            .applyInArrow(last, schema))


def repeat_digest(docs: DataFrame, width: int = WIDTH, key_bits: int = 64) -> DataFrame:
    """doc_id, words, removed words and SHA-256 of the kept words.  Fewer
    ``key_bits`` only let more windows meet that then differ in their checks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(docs, width, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", key_bits)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the words of repeated passages.  A text that loses
    nothing stays byte for byte, others become their kept words joined by one
    space, and a document that loses all its words goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    slim = docs.select("doc_id", "text", rest.alias("rest"))
    kind = slim.schema["rest"].dataType.simpleString()
    out = _run(slim, width, _cleaned, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string, rest {kind}")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, unnest(list_transform(range(1, len(w) - {WIDTH - 2}),
               lambda i: {{'pos': i, 'k': sha256(array_to_string(w[i:i + {WIDTH - 1}], ' '))}}), recursive := true) FROM d WHERE len(w) >= {WIDTH}),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, pos + o AS p FROM win JOIN again USING (k), range(0, {WIDTH}) t(o)),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@register("op9_substring_dedup", ORACLE)
def op9(spark, sf_dir):
    return repeat_digest(table(spark, sf_dir, "documents"))
