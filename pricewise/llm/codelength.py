"""LM scoring: PPM code length per document, and a unigram base score.

The byte-context model (``ppm``) has every context of up to three bytes of all
training documents, with frozen counts; a document's score is the log10
probability of its lower-cased UTF-8 bytes.

The base score needs every word's corpus count, and the score the counts of
every order-3 context.  Each slice of documents sends its distinct words
(128-bit hashes) and its distinct 4-byte strings with its own training counts to
buckets (``buckets``).  A word's bucket adds up and sends the totals back.  A
4-byte string's bucket gets all strings of its context, adds up and sends code
lengths back.  So neither the vocabulary nor the order-3 contexts are ever in
one place; only the counts of 3-byte strings (at most 2^24, and as many as the
alphabet allows) are.

Results in special cases: a null or empty text has one token (the end), no
bytes and score 0; without training documents every count is 0; equal rows
give equal rows; rows with a null id are training rows' opposite: neither held
out nor learned from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm import buckets as B
from pricewise.llm import ppm
from pricewise.llm import textkernel as K
from pricewise.llm.registry import register, table

HELD_OUT = (5, 1)  # crc32(id) modulo 5 is 1: not learned from

COUNT_SCHEMA = "slice int, bucket int, packed binary, n_train long, n_types long"


def train(docs: DataFrame) -> tuple[ppm.LowerOrders, int]:
    """Orders 0 to 2 of the model of all texts with ``learn``, and (about) the
    number of different 4-byte strings in all texts."""
    grams = ppm.gram_counts(docs.select("learn", "text"), ["learn"], lower=True)
    low = (grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("gram"))
           .agg(F.sum(F.when(F.col("learn"), F.col("n")).otherwise(F.lit(0))).alias("n"), F.count("*").alias("kinds")).toArrow())
    gram, n = low["gram"].to_numpy(), low["n"].to_numpy()
    return ppm.LowerOrders(gram[n > 0], n[n > 0]), int(low["kinds"].to_numpy().sum())


def _grams(rows: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, offsets and ``gram_keys`` of every block of texts."""
    return [(lo, hi, o, ppm.gram_keys(K.LOWER[d], o)) for lo, hi, d, o in K.blocks(*K.buffers(rows["text"]))]


def gram_buckets(n_bytes: int, n_slices: int, kinds: int, least: int) -> int:
    """Buckets of 4-byte strings: a power of two, so that none cuts a context."""
    n = max(least, min(n_bytes, n_slices * kinds) // B.BUCKET_VALUES + 1)
    return 1 << min(24, (n - 1).bit_length())


def score_documents(docs: DataFrame, training, key_bits: int = 64) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``training`` is a condition on doc_id (null: no).  Fewer ``key_bits`` only
    let more words meet that then differ in their check bits."""
    docs = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("learn", F.coalesce(training, F.lit(False))))
    spark = docs.sparkSession
    n_bytes = B.text_bytes(docs)
    n_slices, n_buckets = B.plan_sizes(n_bytes, bytes_per_value=30.0)
    lower, kinds = train(docs)
    n_gram_buckets = gram_buckets(n_bytes, n_slices, kinds, n_buckets)  # numbered after those of the words
    model = spark.sparkContext.broadcast(lower)  # counts of 3-byte strings
    ends = docs.where("learn").count()
    dealt = B.into_slices(docs, n_slices)

    def send(rows: pa.Table) -> pa.Table:
        rows = B.in_order(rows)
        number, learnt = rows["slice"][0].as_py(), rows["learn"].to_numpy()
        values, check, place, offs = K.distinct_words(rows["text"], True, key_bits)
        n = np.bincount(place[np.repeat(learnt, np.diff(offs))], minlength=len(values)).astype("<i8")
        of_words = B.sent(number, values, n, n_buckets, key_bits, check)
        held = []
        for lo, hi, o, grams in _grams(rows):
            learn = np.repeat(learnt[lo:hi], np.diff(o))
            values, n = np.unique(grams[learn], return_counts=True)
            held += [(values, n), (np.unique(grams[~learn]), None)]
        values, place = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([np.zeros(len(v)) if n is None else n for v, n in held]),
                        minlength=len(values)).astype("<i8")
        of_grams = B.sent(number, values.astype(np.uint64), n, n_gram_buckets, 32)
        moved = pa.array(of_grams["bucket"].to_numpy() + np.int32(n_buckets), pa.int32())
        return pa.concat_tables([of_words, of_grams.set_column(0, "bucket", moved)])

    def add_up(rows: pa.Table) -> pa.Table:
        n = rows["n"].to_numpy()
        values = np.concatenate([B.unpack(p, k) for p, k in zip(rows["packed"].to_pylist(), n.tolist())])
        extra, of_words = rows["extra"].to_pylist(), rows["bucket"][0].as_py() < n_buckets
        counts = np.concatenate([np.frombuffer(x, dtype="<i8", count=k) for x, k in zip(extra, n.tolist())])
        if of_words:
            check = np.concatenate([np.frombuffer(x, dtype="<u8", offset=8 * k) for x, k in zip(extra, n.tolist())])
            order = np.lexsort((check, values))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(values[order]) != 0) | (np.diff(check[order]) != 0)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.cumsum(new) - 1
            values = values[order][new]
        else:
            values, place = np.unique(values, return_inverse=True)
        sums = np.zeros(len(values), dtype=np.int64)
        np.add.at(sums, place, counts)
        edge = np.cumsum(n)
        if of_words:
            back = sums[place].astype("<i8")
            first = [1] + [0] * (len(n) - 1)  # the bucket's own totals travel once
        else:
            back = model.value.gram_lengths(values, sums).astype("<f4")[place]
            first = [0] * len(n)
        return pa.table({"slice": rows["slice"], "bucket": rows["bucket"],
                         "packed": pa.array([back[e - k:e].tobytes() for e, k in zip(edge, n)], pa.binary()),
                         "n_train": pa.array([int(sums.sum()) * f for f in first], pa.int64()),
                         "n_types": pa.array([int((sums > 0).sum()) * f for f in first], pa.int64())})

    def last(rows: pa.Table, back: pa.Table) -> pa.Table:
        rows = B.in_order(rows)
        values, _, place, offs = K.distinct_words(rows["text"], True, key_bits)
        counts = np.zeros(len(values), dtype=np.int64)
        edges = B.bucket_edges(values, n_buckets, key_bits)
        grams = _grams(rows)
        known_grams = np.unique(np.concatenate([np.unique(g) for *_, g in grams]))
        lengths = np.zeros(len(known_grams), dtype=np.float32)
        gram_edges = B.bucket_edges(known_grams, n_gram_buckets, 32)
        for b, blob in zip(back["bucket"].to_pylist(), back["packed"].to_pylist()):
            if b < n_buckets:
                counts[edges[b]:edges[b + 1]] = np.frombuffer(blob, dtype="<i8")
            else:
                b -= n_buckets
                lengths[gram_edges[b]:gram_edges[b + 1]] = np.frombuffer(blob, dtype="<f4")
        n_tokens = np.diff(offs) + 1

        def per_text(x):
            s = np.concatenate(([0], np.cumsum(x)))
            return s[offs[1:]] - s[offs[:-1]]

        known = per_text((counts > 0)[place]) + (1 if ends else 0)
        logs = per_text(np.log10(counts + 0.5)[place]) + math.log10(ends + 0.5)
        nats = np.zeros(len(rows))
        for lo, hi, o, g in grams:
            full = np.flatnonzero(np.diff(o) > 0)
            if len(full):
                nats[lo + full] = np.add.reduceat(lengths[np.searchsorted(known_grams, g)], o[:-1][full], dtype=np.float64)
        return pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(known, pa.int64()), "logs": pa.array(logs, pa.float64()),
                         "score": pa.array(-nats / math.log(10) + 0.0, pa.float64())})

    totals = dealt.groupBy("slice").applyInArrow(send, B.SENT_SCHEMA).groupBy("bucket").applyInArrow(add_up, COUNT_SCHEMA)
    scored = (dealt.groupBy("slice").cogroup(totals.groupBy("slice"))
              .applyInArrow(last, "doc_id long, n_tokens long, n_known long, logs double, score double"))
    n = totals.agg(F.coalesce(F.sum("n_train"), F.lit(0)) + F.lit(ends)).scalar()
    v = totals.agg(F.coalesce(F.sum("n_types"), F.lit(0)) + F.lit(1 if ends else 0)).scalar()
    return scored.select("doc_id", "n_tokens", "n_known", n.alias("train_tokens"),
                         (F.col("logs") - F.col("n_tokens") * F.log10(n + 0.5 * (v + 1))).alias("base_score"), "score")


def held_out():
    mod, left = HELD_OUT
    return ppm.by_hash(F.col("doc_id"), mod) == left


@register("op8_lm_scoring")
def op8(spark, sf_dir):
    scored = score_documents(table(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
