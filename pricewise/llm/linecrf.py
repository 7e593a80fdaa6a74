"""Quality rules: line labelling by a linear-chain conditional random field.

Every line with a word is content or boilerplate.  A two-state CRF over line
features (length, symbols, digits, capitals, punctuation, repetition, short
words) labels all lines of a text together by Viterbi decoding, and the share
of words on content lines decides whether the text stays.

The CRF is trained by maximum likelihood on a bounded sample of labelled
documents (about ``SAMPLE``, picked by a hash of the id): the lines of a
document of good quality are content, those of a bad one boilerplate, and so
is a line that its own text repeats word for word (texts that fail the base
rules are not learned from).  Only the lines' features
(a few numbers a line) are gathered.

Base rules come first: too few words, or most words inside repeated
three-word windows, and the text fails whatever its lines say.

Results in special cases: a null or blank text has no words and fails; a
blank line is no line; equal rows give equal rows; without labelled documents
of both kinds only the base rules decide; a document with several labels
counts as good if any is; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K
from pricewise.llm.registry import free_name, register, table

SAMPLE = 2000       # labelled documents to learn from (expected number, half of each kind)
MIN_WORDS = 50
MAX_REPEAT = 50     # percent of words in repeated three-word windows
WINDOW = 3
MIN_CONTENT = 0.5   # share of words on content lines for a text to stay
FEATURES = 10
COVER = 7           # place of the repeated-window share among them
ROUNDS = 400        # gradient steps
RIDGE, MOVE_RIDGE = 1e-5, 2e-2  # lines decide mainly for themselves; neighbours settle close calls

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
IS_DIGIT = np.zeros(256, dtype=bool)
IS_DIGIT[ord("0"):ord("9") + 1] = True
IS_UPPER = np.zeros(256, dtype=bool)
IS_UPPER[ord("A"):ord("Z") + 1] = True
IS_OTHER = np.zeros(256, dtype=bool)  # further ASCII punctuation
IS_OTHER[[ord(c) for c in "!\"'()+-/:;=?@[\\]^_`{}~"]] = True
IS_START = np.ones(256, dtype=bool)   # bytes that begin a code point
IS_START[0x80:0xC0] = False
NEWLINE = 0x0A
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord("."), ord(",")]] = True


def _sums(flags: np.ndarray, edges_lo: np.ndarray, edges_hi: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[edges_hi] - total[edges_lo]


def _equal_before(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes in groups (ascending): is there an equal one earlier in the
    group, and is there any other."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = K.mix(h ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    earlier, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


class Measured:
    """Base counts per text and features per line of a block of texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        starts, ends, word_offs = K.words(data, offs)
        text_of = np.repeat(np.arange(n), np.diff(word_offs))
        self.n_words = np.diff(word_offs)
        self.word_chars = _sums(IS_START[data] & K.IS_WORD[data], offs[:-1], offs[1:])
        self.n_symbols = _sums(IS_SYMBOL[data], offs[:-1], offs[1:])
        # words in three-word windows that the text holds more than once
        h = K.word_hashes(data, starts, ends)
        w = K.window_hashes(h, WINDOW)
        at = np.flatnonzero(K.in_text(word_offs, WINDOW, len(w)))
        _, other = _equal_before(w[at], text_of[at] if len(at) else at)
        mask = np.zeros(len(h), dtype=bool)
        mask[at[other]] = True
        in_repeat = K.covered(mask, WINDOW, len(h)) if len(h) else mask
        self.n_repeat_words = _sums(in_repeat, word_offs[:-1], word_offs[1:])
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT * self.n_words)
        # lines with a word: cut at \n
        nl = data == NEWLINE
        breaks = np.flatnonzero(nl)
        lo = np.concatenate((offs[:-1], breaks + 1))
        hi_of = np.concatenate((breaks, offs[1:]))
        owner = np.concatenate((np.arange(n), np.searchsorted(offs, breaks, "right") - 1))
        order = np.lexsort((lo, owner))
        lo, owner = lo[order], owner[order]
        order = np.lexsort((hi_of, np.concatenate((np.searchsorted(offs, breaks, "right") - 1, np.arange(n)))))
        hi = hi_of[order]
        words_in = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
        real = words_in > 0
        lo, hi, owner, words_in = lo[real], hi[real], owner[real], words_in[real]
        self.line_text, self.line_words = owner, words_in
        line_h = K.word_hashes(data, lo, hi) if len(lo) else np.zeros(0, np.uint64)
        again, _ = _equal_before(line_h, owner)
        self.n_dup_lines = np.bincount(owner[again], minlength=n)
        chars = np.maximum(1, _sums(K.IS_WORD[data], lo, hi))
        cover = _sums(in_repeat, np.searchsorted(starts, lo), np.searchsorted(starts, hi))
        short = _sums((ends - starts) <= 2, np.searchsorted(starts, lo), np.searchsorted(starts, hi))

        def share(flags, scale):
            return np.minimum(1.0, _sums(flags, lo, hi) / chars * scale)

        self.features = np.column_stack([
            np.ones(len(lo)), np.log1p(words_in), np.minimum(2.0, chars / words_in / 10), share(IS_SYMBOL[data], 20),
            share(IS_DIGIT[data], 5), share(IS_UPPER[data], 2), share(IS_OTHER[data], 5),
            cover / words_in, short / words_in, np.minimum(2.0, _sums(STOPS[data], lo, hi) / words_in * 4)]) if len(lo) \
            else np.zeros((0, FEATURES))


class LineCrf:
    """Two states (1: content), state weights on features, transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # [FEATURES] for state 1 against 0; [2, 2]

    @staticmethod
    def steps(line_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line numbers within their text, and the order of work: all first
        lines, all second lines, ..."""
        first = np.concatenate(([True], line_text[1:] != line_text[:-1])) if len(line_text) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(line_text)), 0)) if len(line_text) else line_text
        return np.arange(len(line_text)) - start, first

    def layers(self, line_text: np.ndarray) -> list[np.ndarray]:
        number, _ = self.steps(line_text)
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(1, (number.max() if len(number) else 0) + 1))
        return np.split(order, cuts) if len(order) else []

    def viterbi(self, features: np.ndarray, line_text: np.ndarray) -> np.ndarray:
        """The most likely labels, all texts of a block in step; ties go to
        content."""
        score = np.zeros((len(features), 2))
        score[:, 1] = features @ self.weights
        layers, back = self.layers(line_text), np.zeros((len(features), 2), dtype=np.int8)
        for lines in layers[1:]:
            via = score[lines - 1][:, :, None] + self.moves  # from, to
            back[lines] = via[:, 1] >= via[:, 0]
            score[lines] += via.max(axis=1)
        label = np.zeros(len(features), dtype=np.int8)
        if len(features):
            last = np.append(line_text[1:] != line_text[:-1], True)
            label[last] = score[last, 1] >= score[last, 0]
            for lines in layers[:0:-1]:
                label[lines - 1] = back[lines, label[lines]]
        return label

    @staticmethod
    def fit(features: np.ndarray, line_text: np.ndarray, label: np.ndarray, text_weight: np.ndarray) -> LineCrf:
        """Maximum likelihood with a small ridge, by gradient ascent with
        momentum; texts weigh the same whatever their number of lines."""
        crf = LineCrf(np.zeros(features.shape[1]), np.zeros((2, 2)))
        layers = crf.layers(line_text)
        first = crf.steps(line_text)[1]
        weight = text_weight[:, None]
        goal_state = (weight[:, 0] * (label == 1)) @ features
        goal_move = np.zeros((2, 2))
        inner = np.flatnonzero(~first)
        np.add.at(goal_move, (label[inner - 1], label[inner]), text_weight[inner])
        total = text_weight.sum()
        speed_w, speed_m = np.zeros_like(crf.weights), np.zeros((2, 2))
        for _ in range(ROUNDS):
            node = np.zeros((len(features), 2))
            node[:, 1] = features @ crf.weights
            ahead, behind = node.copy(), np.zeros_like(node)
            for lines in layers[1:]:
                ahead[lines] += np.logaddexp.reduce(ahead[lines - 1][:, :, None] + crf.moves, axis=1)
            for lines in layers[:0:-1]:
                behind[lines - 1] = np.logaddexp.reduce(crf.moves + (node[lines] + behind[lines])[:, None, :], axis=2)
            z = np.logaddexp.reduce(ahead + behind, axis=1)
            p1 = np.exp(ahead[:, 1] + behind[:, 1] - z)
            pair = np.exp(ahead[inner - 1][:, :, None] + crf.moves + (node[inner] + behind[inner])[:, None, :] - z[inner][:, None, None])
            grad_w = (goal_state - (weight[:, 0] * p1) @ features) / total - RIDGE * crf.weights
            grad_m = (goal_move - (pair * weight[inner][:, :, None]).sum(axis=0)) / total - MOVE_RIDGE * crf.moves
            speed_w, speed_m = 0.9 * speed_w + grad_w, 0.9 * speed_m + grad_m
            crf.weights, crf.moves = crf.weights + 0.5 * speed_w, crf.moves + 0.5 * speed_m
        return crf


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineCrf | None:
    """CRF from labelled documents; None without both kinds."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}  # one row per kind
    if not all(sizes.get(k) for k in (0, 1)):
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.where(F.expr("false") if not sizes else
                         ((F.col("quality") == 0) & (draw < int(min(1.0, sample / 2 / sizes[0]) * (1 << 20)) + 1))
                         | ((F.col("quality") == 1) & (draw < int(min(1.0, sample / 2 / sizes[1]) * (1 << 20)) + 1)))
    # at most about ``sample`` ids by the bound above
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def measure(batches):
        for batch in batches:
            data, offs = K.buffers(batch.column(1))
            quality = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, d, o in K.blocks(data, offs):
                m = Measured(d, o)
                counts = np.bincount(m.line_text, minlength=hi - lo)
                counts[m.base_failed] = -1  # not the line model's business
                ends = np.cumsum(np.bincount(m.line_text, minlength=hi - lo))
                yield pa.record_batch([pa.array(quality[lo:hi].astype(np.int64)), pa.array(counts.astype(np.int64)),
                                       pa.array([m.features[e - max(c, 0):e].tobytes() for e, c in zip(ends, counts)], pa.binary())],
                                      names=["quality", "lines", "features"])

    got = picked.mapInArrow(measure, "quality long, lines long, features binary").where("lines > 0").toArrow()
    got = got.sort_by([("quality", "ascending"), ("features", "ascending")])  # the same model in any row order
    lines, quality = got["lines"].to_numpy(), got["quality"].to_numpy()
    if not ((quality == 0).any() and (quality == 1).any()):
        return None
    features = np.frombuffer(b"".join(got["features"].to_pylist()), dtype=np.float64).reshape(-1, FEATURES)
    text = np.repeat(np.arange(len(lines)), lines)
    # kinds weigh by their number of labels, each text the same within its kind
    mass = [sizes[0], sizes[1]]
    share = np.where(quality == 1, mass[1] / (quality == 1).sum(), mass[0] / (quality == 0).sum()) / sum(mass)
    label = (np.repeat(quality, lines) == 1) & (features[:, COVER] < 1.0)
    return LineCrf.fit(features, text, label.astype(np.int8), np.repeat(share / lines, lines))


SCHEMA = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "base_failed:boolean,content_share:double,kept:boolean>")


def judge(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``docs`` with a struct column ``quality_rules``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training, labels))  # 14 numbers

    @F.arrow_udf(SCHEMA)
    def rules(text: pa.Array) -> pa.Array:
        data, offs = K.buffers(text)
        crf, parts = model.value, []
        for lo, hi, d, o in K.blocks(data, offs):
            m = Measured(d, o)
            failed = m.base_failed
            if crf is None:
                share = np.ones(hi - lo)
            else:
                good = crf.viterbi(m.features, m.line_text) == 1
                share = np.bincount(m.line_text, weights=m.line_words * good, minlength=hi - lo) / np.maximum(1, m.n_words)
            parts.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, share,
                          ~failed & (share >= MIN_CONTENT)))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (*["i8"] * 5, bool, float, bool)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64) if c.dtype.kind == "i" else c) for c in cols], names=names)

    return docs.withColumn(free_name(docs.columns, "quality_rules"), rules(F.col("text").cast("string")))


@register("op7_quality_rules")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality_rules.*")
