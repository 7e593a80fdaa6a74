"""Language identification by prediction by partial matching.

One byte-context trie per language is trained on a bounded sample of labelled
documents (about ``SAMPLE`` per language, picked by a hash of the id, whole
texts).  A text's language is the one whose frozen model gives the shortest
exact code length over the whole text.

Results in special cases: a null text or one without a letter is ``und`` with
score 0; with nothing to learn from every text is ``und``; equal code lengths
go to the first language in alphabetical order; rows whose label or id is null
are not learned from but are predicted; equal rows give equal rows; an empty
table gives no rows; all other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm import ppm
from pricewise.llm import textkernel as K
from pricewise.llm.registry import free_name, register, table

SAMPLE = 1000     # labelled documents per language to learn from (expected number)
UNKNOWN = "und"
HELD_OUT = (4, 2)  # crc32(id) modulo 4 is 2: not learned from

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[ord("a"):ord("z") + 1] = True
IS_LETTER[ord("A"):ord("Z") + 1] = True


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], ppm.Tables | None]:
    """Languages and compiled models learned from ``docs`` (text, lang, doc_id)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return [], None
    pick = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    for lang, n in sorted(sizes.items()):
        pick = pick | ((F.col("lang") == lang) & (draw < int(min(1.0, sample / n) * (1 << 20)) + 1))
    # counts over the sample: SAMPLE documents per language bound them
    grams = ppm.gram_counts(known.where(pick).select("lang", "text"), ["lang"], lower=True).toArrow()
    of, gram, n = (grams[c].to_numpy(zero_copy_only=False) for c in ("lang", "gram", "n"))
    languages = sorted(sizes)
    tries = [ppm.Trie.whole(gram[of == lang], n[of == lang]) for lang in languages]
    return languages, ppm.Tables(tries)


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``docs`` with a last column, a struct ``language`` (lang_pred, score); if
    the name is taken it gets underscores in front."""
    languages, tables = train(docs if training is None else training)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((languages, tables))  # 1 KB per context and language of the sampled documents

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        languages, tables = model.value
        data, offs = K.buffers(text)
        names, scores = [], []
        for lo, hi, d, o in K.blocks(data, offs):
            letters = np.concatenate(([0], np.cumsum(IS_LETTER[d])))
            has = letters[o[1:]] > letters[o[:-1]]
            for i in np.flatnonzero(~has):
                has[i] = any(map(str.isalpha, d[o[i]:o[i + 1]].tobytes().decode()))
            if tables is None:
                has[:] = False
                cost = np.zeros((hi - lo, 1))
            else:
                cost = tables.costs(K.LOWER[d], o)
            best = cost.argmin(axis=1)
            share = 1.0 / np.exp(np.minimum(0.0, cost.min(axis=1, keepdims=True) - cost)).sum(axis=1)
            names += [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has.tolist())]
            scores.append(np.where(has, share, 0.0))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
            names=["lang_pred", "score"])

    return docs.withColumn(free_name(docs.columns, "language"), predict(F.col("text").cast("string")))


def held_out():
    mod, left = HELD_OUT
    return ppm.by_hash(F.col("doc_id"), mod) == left


@register("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                        "language.lang_pred", "language.score")
