"""Importance resampling of documents towards a target collection.

Features of a text are its runs of one to three words, hashed to buckets by
the CRC-32 of the words joined by one space.  The gain of a bucket is the log
ratio of its shares in the target and in the documents; a document's weight is
the sum of its features' gains, and adding Gumbel noise drawn from the id turns
the highest scores into a sample without replacement.

Distinct words, each between two delimiters, are the patterns of an Aho-Corasick
automaton, with a word's CRC and length as its payload.  A scan over the
delimited text emits payloads in order, and the CRC of a run follows from the
payloads of its words alone: a CRC moves past n bytes by a linear map of its 32
bits.  No run of words is ever built as a string.  Every task learns its own
patterns from the text it reads, the words seen ``REPEATS`` times or more after
1, 2, 4, 8, ... blocks; past ``WORDS`` patterns it starts again with the newest.
A word that isn't a pattern (yet), or has over ``WORD_BYTES`` bytes, gets the
same payload from its bytes, so results don't depend on what was learned.

Results in special cases: a null or empty text, or one without a word, has no
feature and weight 0; an empty target has no feature, its total is 0; a null id
is hashed as an empty one and comes after others of the same score; rows that
share an id share its noise; equal rows share a score and get ranks of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K
from pricewise.llm.registry import register, table
from pricewise.session import cut_lineage

BUCKETS = 10_000
RUN = 3               # words in the longest feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
WORDS = 1 << 17       # patterns of one task
REPEATS = 8           # occurrences that make a word a pattern
WORD_BYTES = 255      # longest pattern

SPACE = 0x20
_LENGTH_BITS = 9      # of a payload, beside the CRC


def _step_table() -> np.ndarray:
    """CRC-32 of one byte after a zero register (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


STEP = _step_table()


def _past_zero(c: np.ndarray) -> np.ndarray:
    return STEP[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _maps() -> np.ndarray:
    """[n, k, b]: the register b << 8k moved past n zero bytes, n <= WORD_BYTES."""
    at = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    out = [at]
    for _ in range(WORD_BYTES):
        out.append(_past_zero(out[-1]))
    return np.array(out, dtype=np.uint32)


MAPS = _maps()


def _apply(m: np.ndarray, c: int) -> int:
    return int(m[0, c & 255] ^ m[1, c >> 8 & 255] ^ m[2, c >> 16 & 255] ^ m[3, c >> 24])


def _far(c: int, n: int) -> int:
    """Register ``c`` moved past ``n`` zero bytes, by repeated doubling."""
    m = MAPS[1]
    while n:
        if n & 1:
            c = _apply(m, c)
        m = _move(m, m)
        n >>= 1
    return c


def _move(c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers ``c`` under one map ``m``."""
    return (m[0][c & np.uint32(255)] ^ m[1][c >> np.uint32(8) & np.uint32(255)]
            ^ m[2][c >> np.uint32(16) & np.uint32(255)] ^ m[3][c >> np.uint32(24)])


def past(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs ``c`` moved past ``n`` further bytes each."""
    near = np.minimum(n, WORD_BYTES)
    flat, at = MAPS.reshape(-1), near * 1024
    out = flat[at + (c & np.uint32(255))]
    out ^= flat[at + 256 + (c >> np.uint32(8) & np.uint32(255))]
    out ^= flat[at + 512 + (c >> np.uint32(16) & np.uint32(255))]
    out ^= flat[at + 768 + (c >> np.uint32(24))]
    for i in np.flatnonzero(n > WORD_BYTES):
        out[i] = _far(int(c[i]), int(n[i]))
    return out


def with_space(c: np.ndarray) -> np.ndarray:
    """CRCs ``c`` of strings, each with one space added."""
    r = ~c
    return ~(STEP[(r ^ np.uint32(SPACE)) & np.uint32(255)] ^ (r >> np.uint32(8)))


DELIMITED = np.where(K.IS_TERM, K.LOWER, np.uint8(SPACE)).astype(np.uint8)  # words in lower case, all else a space


class Words:
    """Automaton over delimiter-bounded words with (CRC, length) payloads."""

    def __init__(self, limit: int = WORDS):
        self.limit, self.known, self.scanner = limit, set(), None
        self.counts: Counter[bytes] = Counter()
        self.blocks = 0

    def learn(self) -> None:
        """Turn the words that have come back often enough into patterns."""
        new = {w for w, n in self.counts.items() if n >= REPEATS and len(w) <= WORD_BYTES}
        self.counts.clear()
        if not new:
            return
        if self.scanner is None or len(self.known) + len(new) > self.limit:
            self.scanner, self.known = ahocorasick.Automaton(), set()
        for w in new:
            self.scanner.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << _LENGTH_BITS | len(w))
        self.known |= new
        self.scanner.make_automaton()

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC and length of every word of a delimited text (bytes are
        scanned as Latin-1 characters, so places are byte places)."""
        start, end, _ = K.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), _NOT_SPACE)
        flat = np.fromiter(chain.from_iterable(self.scanner.iter(text.decode("latin-1"))) if self.known else (), dtype=np.int64)
        at, payload = np.searchsorted(end, flat[0::2]), flat[1::2]
        crc, length = np.zeros(len(start), dtype=np.uint32), end - start
        crc[at] = (payload >> _LENGTH_BITS).astype(np.uint32)
        length[at] = payload & ((1 << _LENGTH_BITS) - 1)
        if len(at) < len(start):  # words that aren't patterns
            rest = np.ones(len(start), dtype=bool)
            rest[at] = False
            words = [text[i:j] for i, j in zip(start[rest].tolist(), end[rest].tolist())]
            crc[rest] = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
            self.counts.update(words)
        self.blocks += 1
        if self.blocks & (self.blocks - 1) == 0 or len(self.counts) > self.limit:
            self.learn()  # after 1, 2, 4, 8, ... blocks
        return start, crc, length


_NOT_SPACE = np.arange(256) != SPACE


def features(crc: np.ndarray, length: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every run length, which words begin a run inside their text and the
    CRC of each such run.  ``of`` is the text of each word."""
    out, runs = [(np.arange(len(crc)), crc)], crc
    for k in range(1, RUN):
        runs = past(with_space(runs[:-1]), length[k:]) ^ crc[k:]
        inside = np.flatnonzero(of[k:] == of[:-k])
        out.append((inside, runs[inside]))
    return out


def scanned(texts: pa.Array, words: Words) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """First and last text of every block, the words' texts, ``features``."""
    for lo, hi, d, o in K.blocks(*K.buffers(texts)):
        d = DELIMITED[d]
        start, crc, length = words.payloads(b" " + b" ".join(d[a:b].tobytes() for a, b in zip(o[:-1], o[1:])) + b" ")
        of = np.searchsorted(o + np.arange(len(o)) + 1, start, "right") - 1  # one delimiter before each text
        yield lo, hi, of, features(crc, length, of)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket.  Every task sends one row per
    bucket at most; ``buckets`` rows reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(buckets, dtype=np.int64), Words()
        for batch in batches:
            for _, _, _, runs in scanned(batch.column(0), words):
                for _, crc in runs:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, from the counts of both sides."""
    n = len(target)
    t_all, s_all = float(target.sum()), float(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for t, s in zip(target.tolist(), source.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    gain = gains(bucket_counts(target, buckets), bucket_counts(docs, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for batch in texts:
            n, weight = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for lo, hi, text, runs in scanned(batch, words):
                n[lo:hi] = np.bincount(text, minlength=hi - lo)
                for begin, crc in runs:
                    upto = np.concatenate(([0], np.cumsum(shared.value[crc % np.uint32(buckets)])))
                    edge = np.searchsorted(text[begin], np.arange(hi - lo + 1))
                    weight[lo:hi] += upto[edge[1:]] - upto[edge[:-1]]
            runs_of = [np.maximum(n - k, 0) for k in range(RUN)]
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(sum(runs_of)), pa.array(weight)],
                                             names=["n_words", "n_features", "weight"])

    of.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    measure = F.arrow_udf(of, "struct<n_words:long,n_features:long,weight:long>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(draw)))
    return (docs.select("doc_id", measure(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("m"))
            .select("doc_id", "m.*", (F.col("m.weight") + noise).cast("long").alias("score")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``weigh`` with ``rank`` among the documents drawn: of those with at
    least ``least_words`` words, ``percent`` in a hundred, by falling score."""
    weighed = cut_lineage(weigh(docs, target, buckets, seed))  # six numbers a row: the range sampling reads it twice
    enough = F.col("n_words") >= least_words
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at")]
    placed = (weighed.withColumn("at", F.monotonically_increasing_id())  # parts equal rows
              .repartitionByRange(*order).sortWithinPartitions(*order).drop("at"))
    # partition number in the upper bits, place in the partition in the lower 33
    placed = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    # one row per partition of the range partitioning: as many as shuffle partitions
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(enough).alias("enough"))
    drawn = (parts.agg(F.sum("enough").alias("n")).first()["n"] or 0) * percent // 100
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (placed.join(F.broadcast(offsets), "part")
            .select("doc_id", "n_words", "n_features", "weight", "score",
                    F.when(enough & (place <= drawn), place).cast("long").alias("rank")))


def _oracle() -> str:
    """The same in DuckDB SQL: CRC-32 byte by byte over each distinct feature."""
    step = "c >> 8"
    for k in range(8):  # the step table is linear in the bits of its index
        step = f"xor({step}, ((xor(c, b) >> {k}) & 1) * {int(STEP[1 << k])})"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH w AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, {words} AS w FROM documents
           UNION ALL SELECT 1, row_number() OVER (), NULL, {words} FROM benchmark),
runs AS (
  SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                           || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
  FROM w),
n AS (SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: {step})) % 10000 AS bucket
  FROM hexed),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
      FROM n JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
                                     / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE))) AS gain FROM s),
d AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
e AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
                                                     + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score
  FROM w LEFT JOIN d USING (r) WHERE side = 0),
k AS (SELECT doc_id, n_words, n_features, weight, score,
             row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS place FROM e)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM e WHERE n_words >= 20) THEN place END AS rank
FROM k
"""


@register("op13_importance_resampling", _oracle())
def op13(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
