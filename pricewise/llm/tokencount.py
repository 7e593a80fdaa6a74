"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

Offline, every vocabulary string is run through the merges on its own; those
that come out as one token are *whole tokens*.  A document is cut into
pre-tokens, and a pre-token that is a whole token counts as 1 without any
merge.  The rest is merged, all distinct ones of a batch at once: one array
step per merge round, lowest rank first, leftmost among equals.

The vocabulary's path is a parameter.  The compiled model (ids, merge table,
whole tokens; its size is set by the vocabulary file) is broadcast.

Results in special cases: a null or empty text has 0 bytes and 0 tokens; the
added special token's string inside a text is one token; lone long runs are
merged with a heap, so time stays near-linear; equal rows give equal rows;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K
from pricewise.llm.merging import PairTable, merge_rows
from pricewise.llm.registry import register, table

LIMIT = 1024
LONG = 64            # bytes; longer pre-tokens go through the heap
CACHE = 200_000      # remembered pre-tokens per worker, beyond the vocabulary
# Fixed value: the pre-token pattern of this vocabulary family; white space is
# Unicode's White_Space property.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Compiled vocabulary: single bytes' ids, merges, whole tokens."""

    def __init__(self, spec: dict):
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for ch, b in alphabet.items():
            self.byte_ids[b] = vocab[ch]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.table = PairTable(pairs, np.arange(len(merges), dtype=np.int32), made)
        self.merges = {int(p): (r, int(m)) for r, (p, m) in enumerate(zip(pairs, made))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        raw = [bytes(alphabet[c] for c in s) for s in vocab if all(c in alphabet for c in s)]
        counts = self.merge_counts(raw)
        self.whole = set()  # proven: encodes alone as one token
        for b, n in zip(raw, counts):
            if n == 1:
                try:
                    self.whole.add(b.decode())
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token

    def merge_counts(self, raw: list[bytes]) -> list[int]:
        """Number of tokens of each byte string (merged on its own)."""
        out = [0] * len(raw)
        by_len = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        short = [i for i in by_len if 0 < len(raw[i]) <= LONG]
        for lo in range(0, len(short), 1 << 14):
            part = short[lo:lo + (1 << 14)]
            for i, n in zip(part, self._merge_block([raw[i] for i in part])):
                out[i] = n
        for i in by_len[::-1]:
            if len(raw[i]) <= LONG:
                break
            out[i] = self._merge_long(raw[i])
        return out

    def _merge_block(self, raw: list[bytes]) -> list[int]:
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        width = int(lens.max())
        ids = np.zeros((len(raw), width), dtype=np.int32)
        cols = np.arange(width)
        ids[cols < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return merge_rows(ids, lens, self.table)[1].tolist()

    def _merge_long(self, raw: bytes) -> int:
        """Heap of candidate merges over a linked list."""
        ids = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(ids)
        nxt, prv, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = []

        def offer(i):
            j = nxt[i]
            if j < n:
                m = self.merges.get(ids[i] << 32 | ids[j])
                if m:
                    heap.append((m[0], i, ids[i], ids[j], m[1])) if not ready else heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        ready = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = new, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            left -= 1
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return left


class Counter:
    """Token counts of texts, with the whole tokens and a bounded memory."""

    def __init__(self, model: Bpe):
        self.model = model
        self.known = dict.fromkeys(model.whole, 1)
        self.older: dict[str, int] = {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, model.special))) if model.special else None

    def learn(self, tokens: Iterable[str]) -> None:
        """Counts of tokens not met lately, into the memory (two generations:
        what the older one holds is taken over when met)."""
        tokens = set(tokens)
        new = tokens.difference(self.known)
        if len(self.known) + len(new) > CACHE + len(self.model.whole):
            self.older, self.known = self.known, dict.fromkeys(self.model.whole, 1)
            new = tokens.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((t, self.older[t]) for t in again)
        new = list(new.difference(again))
        self.known.update(zip(new, self.model.merge_counts([t.encode() for t in new])))

    def counts(self, texts: list[str | None]) -> list[int]:
        out, special = [0] * len(texts), self.special
        size, held = 0, []
        for i, text in enumerate(texts):
            if text:
                parts = [text]
                if special and special.search(text):
                    out[i] = sum(1 for _ in special.finditer(text))
                    parts = special.split(text)
                toks = list(chain.from_iterable(map(self.split, parts)))
                held.append((i, toks))
                size += len(toks)
                if size > 200_000:
                    self.settle(held, out)
                    size, held = 0, []
        self.settle(held, out)
        return out

    def settle(self, held: list, out: list[int]) -> None:
        self.learn(chain.from_iterable(t for _, t in held))
        get = self.known.__getitem__
        for i, toks in held:
            out[i] += sum(map(get, toks))


def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


_counters: dict[int, Counter] = {}


def token_count(spark: SparkSession, path: str) -> Column:
    """Column function text -> number of tokens."""
    model = spark.sparkContext.broadcast(load(path))

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        key = id(model.value)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(model.value)
        return pa.array(_counters[key].counts(text.to_pylist()), pa.int64())

    return count


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op6_token_counts")
def op6(spark, sf_dir):
    docs: DataFrame = table(spark, sf_dir, "documents")
    count = token_count(spark, vocabulary("byte_bpe_50k.json"))
    return (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        count("text").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > LIMIT))
