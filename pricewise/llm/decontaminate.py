"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages.  Passages are TF-IDF vectors over
the benchmark's words; words in more than ``STOP_SHARE`` of all passages are
left out (every item keeps its ``LIVE_WORDS`` rarest).  A randomised SVD of the passage matrix A gives the latent space:
one pass sums Y = A'A W for a test matrix W (a small matrix per
partition, added up by Spark), and the Nystrom form of A'A from Y and W gives
the leading right singular vectors.  Passages and benchmark items are compared
by cosine in that space; an item longer than the widest passage is cut into
queries of that width, which overlap by half.  Every passage with a vector word
is compared, however long the items of the block are.  Pairs over
``MIN_COSINE`` are candidates (those without the words for any match are
dropped at once), and a candidate counts when the longest common
subsequence of words covers at least ``MIN_SHARE`` of the item, or at least
``MIN_PARAPHRASE`` and the item's answer (its last ``ANSWER_WORDS`` words)
stands in the passage word for word.  The common subsequence is always that of
the whole item.

The benchmark is the stated query set: it is taken in blocks of ``BLOCK_ITEMS``
queries (at least one item), and each block meets all passages of all documents, in whole texts.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased
in A-Z and in Latin-1's letters.  Results in special cases: null or empty texts and items match
nothing; an item matches a document once, with its best share; equal items
both match; equal rows give equal rows; an empty benchmark or document table
gives no match; all other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K
from pricewise.llm.merging import PairTable
from pricewise.llm.registry import free_name, register, table

PASSAGES = ((24, 8), (40, 16), (64, 32))  # words and stride of the passages compared
COUNTED = 64                     # words of the (disjoint) passages counted and decomposed
STOP_SHARE, STOP_COUNT = 0.002, 20  # a word in more passages than both is left out ...
LIVE_WORDS = 8                      # ... unless it is among the rarest of an item
RANDOM = 24                         # random columns of the test matrix, beside the items
MIN_COSINE = 0.45
MIN_SHARE = 0.7
MIN_PARAPHRASE = 0.5
ANSWER_WORDS = 5
BLOCK_ITEMS = 256


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and word offsets by text."""
    d = K.lower_latin(data)
    starts, ends, word_offs = K.words(d, offs, K.IS_TERM)
    return K.word_hashes(d, starts, ends), word_offs


def passages(word_offs: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of passages that cover every text."""
    n = np.diff(word_offs)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // stride)), 0)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    lo = word_offs[:-1][text] + number * stride
    return text, lo, np.minimum(lo + width, word_offs[1:][text])


class Vocabulary:
    """Words of the benchmark block, by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        keys = (self.hashes >> np.uint64(1)).astype(np.int64)
        n = len(keys)
        self.index = PairTable(keys, np.zeros(n, np.int32), np.arange(n, dtype=np.int32), max(10, (4 * n).bit_length()))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't in the benchmark."""
        return self.index.made[self.index.find_keys((h >> np.uint64(1)).astype(np.int64))]


def _count_pass(docs: DataFrame, words: Vocabulary) -> tuple[np.ndarray, int]:
    """Passages with each benchmark word, and passages in all."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the block of items

    def run(batches):
        words = shared.value
        df, total = np.zeros(len(words.hashes), dtype=np.int64), 0
        for batch in batches:
            data, offs = K.buffers(batch.column(0))
            for _, _, d, o in K.blocks(data, offs):
                h, wo = term_hashes(d, o)
                cells, n = tf_cells(words.find(h), wo)
                df += np.bincount(np.unique(cells[0] * len(df) + cells[1]) % len(df), minlength=len(df))
                total += n
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], names=["term", "n"])

    got = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")
           .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    df, total = np.zeros(len(words.hashes), dtype=np.int64), 0
    for t, n in zip(got["term"].to_pylist(), got["n"].to_pylist()):
        if t < 0:
            total = n
        else:
            df[t] = n
    return df, total


def tf_cells(found: np.ndarray, word_offs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """(passage, term) of every benchmark word, in disjoint passages, and
    the number of passages."""
    n = np.diff(word_offs)
    count = -(-n // COUNTED)
    first = np.cumsum(count) - count
    at = np.flatnonzero(found >= 0)
    text = np.searchsorted(word_offs, at, "right") - 1
    return (first[text] + (at - word_offs[text]) // COUNTED, found[at].astype(np.int64)), int(count.sum())


def _sketch_pass(docs: DataFrame, words: Vocabulary, idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Y = A'A W over all passages of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((words, idf, test.astype(np.float32)))

    def run(batches):
        words, idf, test = shared.value
        weighted = (test * idf[:, None]).astype(np.float32)
        y = np.zeros(test.shape)
        for batch in batches:
            data, offs = K.buffers(batch.column(0))
            for _, _, d, o in K.blocks(data, offs):
                h, wo = term_hashes(d, o)
                (row, term), n = tf_cells(words.find(h), wo)
                live = idf[term] > 0
                row, term = row[live], term[live]
                if not len(row):
                    continue
                # rows in groups that keep the dense part small
                edges = np.searchsorted(row, np.arange(0, n + 512, 512))
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    r, t = row[a:b], term[a:b]
                    used, tt = np.unique(t, return_inverse=True)
                    r0 = r[0]
                    dense = np.bincount((r - r0) * len(used) + tt, minlength=int(r[-1] - r0 + 1) * len(used))
                    dense = dense.reshape(-1, len(used)).astype(np.float32)
                    y[used] += dense.T @ (dense @ weighted[used])
        y *= idf[:, None]
        step = 256  # terms per row sent
        parts = range(0, len(y), step)
        yield pa.record_batch([pa.array([i // step for i in parts], pa.int32()),
                               pa.array([y[i:i + step].tobytes() for i in parts], pa.binary())], names=["part", "y"])

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for blob in rows["y"].to_pylist():
            v = np.frombuffer(blob, dtype=np.float64)
            total = v.copy() if total is None else total + v
        return pa.table({"part": rows["part"].slice(0, 1), "y": pa.array([total.tobytes()], pa.binary())})

    got = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, y binary")
           .groupBy("part").applyInArrow(add, "part int, y binary").toArrow().sort_by("part"))
    y = np.frombuffer(b"".join(got["y"].to_pylist()), dtype=np.float64)
    return y.reshape(-1, test.shape[1]) if len(y) else np.zeros(test.shape)


def latent_space(y: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and singular values of A, from
    Y = A'A W (Nystrom form with a small shift for stability)."""
    shift = 1e-8 * max(1e-12, np.linalg.norm(y))
    y = y + shift * test
    core = test.T @ y
    root = np.linalg.cholesky((core + core.T) / 2)
    u, s, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    keep = s > 1e-6 * max(s[0], 1e-12)
    return u[:, keep], np.sqrt(np.maximum(0.0, s[keep] ** 2 - shift))


@dataclass
class Items:
    """A block of the benchmark, ready to be looked for."""
    ids: list[int]
    hashes: list[np.ndarray]  # the words of each
    words: Vocabulary
    embed: np.ndarray         # word -> latent space, weighted
    queries: np.ndarray       # [queries, 3]: item, and the item's words before and after the query
    vectors: np.ndarray       # queries in latent space, length 1
    times: np.ndarray         # [items, words + 1]: how often the item has the word (the last: not in the benchmark)
    answer: np.ndarray        # likewise: is it a word of the item's answer

    def masks(self, item: int) -> dict[int, int]:
        """Places of every word of an item, as bits."""
        if item not in self.__dict__.setdefault("_masks", {}):
            m: dict[int, int] = {}
            for i, h in enumerate(self.hashes[item].tolist()):
                m[h] = m.get(h, 0) | 1 << i
            self._masks[item] = m
        return self._masks[item]


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def possible(items: Items, found: np.ndarray, item: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """For every (item, span of words x to y) whether it can count: no common
    subsequence is longer than the item's words that the span has, or than the
    span's words that the item has, and an answer needs all its words."""
    out = np.zeros(len(x), dtype=bool)
    size = np.array([len(h) for h in items.hashes], dtype=np.int64)
    answer = items.answer.sum(axis=1)
    cut = np.cumsum(y - x) // step
    for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(cut)) + 1) if len(x) else ():
        width, own = y[at] - x[at], item[at]
        first = np.cumsum(width) - width
        place = np.arange(int(width.sum())) + np.repeat(x[at] - first, width)
        have = items.times[np.repeat(own, width), found[place]] > 0
        many = np.add.reduceat(have, first, dtype=np.int64) / size[own] >= MIN_PARAPHRASE
        have &= np.repeat(many, width)
        pair = np.unique(np.repeat(np.arange(len(at)), width)[have] * items.times.shape[1] + found[place[have]])
        span, word = np.divmod(pair, items.times.shape[1])
        most = np.bincount(span, weights=items.times[own[span], word], minlength=len(at)) / size[own]
        ends = np.bincount(span, weights=items.answer[own[span], word], minlength=len(at)) == answer[own]
        out[at] = many & ((most >= MIN_SHARE) | (most >= MIN_PARAPHRASE) & ends)
    return out


def find(items: Items, data: np.ndarray, offs: np.ndarray) -> list[list[dict]]:
    """Matches of every text of a block."""
    out: list[dict[int, dict]] = [{} for _ in range(len(offs) - 1)]
    h, wo = term_hashes(data, offs)
    found = items.words.find(h)
    at = np.flatnonzero(found >= 0)
    at = at[items.embed[found[at]].any(axis=1)] if len(at) else at
    sums = np.zeros((len(at) + 1, items.embed.shape[1]))
    np.cumsum(items.embed[found[at]], axis=0, out=sums[1:])
    sums = sums.astype(np.float32)
    sizes = np.array([len(x) for x in items.hashes], dtype=np.int64)
    seen = set()
    for width, stride in PASSAGES:
        text, lo, hi = passages(wo, width, stride)
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
        busy = np.flatnonzero(b > a)
        if not len(busy):
            continue
        # neighbours with the same vector words are one passage
        first = np.flatnonzero(np.concatenate(([True], (np.diff(a[busy]) != 0) | (np.diff(b[busy]) != 0))))
        hi[busy[first]] = np.maximum.reduceat(hi[busy], first)
        busy = busy[first]
        for part in np.array_split(busy, max(1, len(busy) // 4096)):
            v = sums[b[part]] - sums[a[part]]
            size = np.linalg.norm(v, axis=1)
            cosine = (v / np.maximum(size, 1e-9)[:, None]) @ items.vectors.T
            p, j = np.nonzero(cosine >= MIN_COSINE)
            k, (item, before, after) = part[p], items.queries[j].T
            # the passage, and as much around it as the item may reach
            x = np.maximum(wo[text[k]], lo[k] - before - sizes[item] // 2)
            y = np.minimum(wo[text[k] + 1], hi[k] + after + sizes[item] // 2)
            able = possible(items, found, item, x, y)
            for t, item, x, y, c in zip(*(z[able].tolist() for z in (text[k], item, x, y, cosine[p, j]))):
                n, old = len(items.hashes[item]), out[t].get(item)
                if (x, y, item) in seen or old and old["lcs_share"] == 1:
                    continue
                seen.add((x, y, item))
                words = h[x:y].tolist()
                share = common_subsequence(items.masks(item), n, words) / n
                if share < MIN_PARAPHRASE:
                    continue
                answer = items.hashes[item][-ANSWER_WORDS:].tolist()
                stands = any(words[i:i + len(answer)] == answer for i in range(len(words) - len(answer) + 1))
                if share >= MIN_SHARE or stands:
                    if old is None or share > old["lcs_share"]:
                        out[t][item] = {"item_id": items.ids[item], "cosine": min(1.0, c), "lcs_share": share, "answer": stands}
    return [[m[i] for i in sorted(m)] for m in out]


def prepare(docs: DataFrame, block: list[tuple[int, str]]) -> Items | None:
    """Latent space of the documents for a block of items."""
    texts = pa.array([t or "" for _, t in block], pa.string())
    h, wo = term_hashes(*K.buffers(texts))
    keep = [i for i in range(len(block)) if wo[i + 1] > wo[i]]
    if not keep:
        return None
    words = Vocabulary(h)
    df, total = _count_pass(docs, words)
    text, lo, hi = passages(wo, *PASSAGES[-1])
    found = [words.find(h[a:b]) for a, b in zip(lo, hi)]
    queries = np.stack([np.searchsorted(keep, text), lo - wo[text], wo[text + 1] - hi], axis=1)
    whole = [words.find(h[wo[i]:wo[i + 1]]) for i in keep]
    times = np.array([np.bincount(f, minlength=len(df) + 1) for f in whole], dtype=np.int32)
    answer = np.zeros(times.shape, dtype=bool)
    for i, f in enumerate(whole):
        answer[i, f[-ANSWER_WORDS:]] = True
    live = df <= max(STOP_COUNT, STOP_SHARE * total)
    for f in found:
        own = np.unique(f)
        live[own[np.argsort(df[own], kind="stable")[:LIVE_WORDS]]] = True
    idf = np.where(live, np.log((1 + total) / (1 + df)) + 1.0, 0.0)
    # the test matrix: random columns, and the queries themselves, so that the
    # space holds what lies near an item however rare it is in the documents
    tf = np.array([np.bincount(f, minlength=len(idf)) * idf for f in found])
    test = np.vstack([tf, np.random.default_rng(7).standard_normal((RANDOM, len(idf))) * (idf > 0)])
    test = np.linalg.qr(test.T)[0]
    v, _ = latent_space(_sketch_pass(docs, words, idf, test), test)
    embed = (idf[:, None] * v).astype(np.float32)
    vectors = np.array([embed[f].sum(axis=0) for f in found])
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    return Items([block[i][0] for i in keep], [h[wo[i]:wo[i + 1]] for i in keep], words, embed, queries, vectors, times, answer)


MATCHES = "array<struct<item_id:bigint,cosine:double,lcs_share:double,answer:boolean>>"


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with a last column ``matches``, the benchmark items found in it;
    if the name is taken it gets underscores in front."""
    name = free_name(docs.columns, "matches")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    block, held, done = [], 0, docs.withColumn(name, F.array().cast(MATCHES))
    spark = docs.sparkSession

    def with_block(frame: DataFrame) -> DataFrame:
        ready = prepare(docs, block)
        if ready is None:
            return frame
        shared = spark.sparkContext.broadcast(ready)  # bounded by BLOCK_ITEMS items

        @F.arrow_udf(MATCHES)
        def look(text: pa.Array) -> pa.Array:
            data, offs = K.buffers(text)
            rows = [m for _, _, d, o in K.blocks(data, offs) for m in find(shared.value, d, o)]
            return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()),
                                                      ("lcs_share", pa.float64()), ("answer", pa.bool_())])))

        return frame.withColumn(name, F.concat(name, look(F.col("text").cast("string"))))

    for row in items.toLocalIterator():
        _, wo = term_hashes(*K.buffers(pa.array([row[1]], pa.string())))
        n = max(1, len(passages(wo, *PASSAGES[-1])[0]))
        if block and held + n > BLOCK_ITEMS:
            done, block, held = with_block(done), [], 0
        block.append((row[0], row[1]))
        held += n
    return with_block(done) if block else done


@register("op4_benchmark_decontamination")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
