"""License scan: a positional rare-token index over licence templates.

Every template is a short licence text or name.  The index holds, for each
template's rarest words (highest IDF over the corpus), the word and its place
in the template.  A document looks its words up in the index, every hit
proposes a start (its place minus the word's place in the template), and a
template's starts are the intersection over its indexed words.  A start counts
when the template's mandatory key phrases stand there word for word; the score
is the IDF-weighted share of template words that stand in place.

Only DataFrame functions are used.  The scan is one narrow projection; the
IDF table is one aggregate over the corpus with as many groups as the
templates have words.

A text's words are runs of ASCII letters, digits and non-ASCII characters,
with A-Z lower-cased.  Results in special cases: a null or empty text has no
words, score 0 and empty labels; overlapping places all count; equal rows give
equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.llm.registry import free_name, register, table

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE = 3  # indexed words per template
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()  # mandatory phrases (parts of text); none: all of it
    base: bool = False


# The four base phrases, then names and opening sentences of
# published licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("apache-2", "apache license version 2 0"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("gpl-text", "you can redistribute it and or modify it under the terms of the gnu general public license",
             ("redistribute it and or modify it under the terms",)),
    Template("apache-text", "you may not use this file except in compliance with the license",
             ("not use this file except in compliance",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


def word_array(text: Column) -> Column:
    """The text's words, case kept."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def ascii_lower(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def idf_table(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF over the whole corpus of every word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    n = docs.count()
    own = F.array_distinct(ascii_lower(F.filter(word_array(F.col("text")), lambda w: F.lower(w).isin(vocabulary))))
    df = docs.select(F.explode(own).alias("w")).groupBy("w").count().where(F.col("w").isin(vocabulary)).collect()
    seen = {r.w: r["count"] for r in df}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1.0 for w in vocabulary}


def rare_words(t: Template, idf: dict[str, float], rare: int = RARE) -> list[tuple[str, int]]:
    """The template's rarest distinct words and their (first) places; a word
    that the template repeats proposes no single start and is passed over
    unless nothing else is left: then one repeated word proposes a start for
    each of its places."""
    words = t.text.split()
    once = [(w, i) for i, w in enumerate(words) if words.count(w) == 1]
    if once:
        return sorted(once, key=lambda x: (-idf[x[0]], x[1]))[:rare]
    rarest = min(words, key=lambda w: (-idf[w], words.index(w)))
    return [(rarest, i) for i, w in enumerate(words) if w == rarest]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """All columns of ``docs``, then a struct ``license``: n_words, places
    (array of label, start, score, base); if the name is taken it gets
    underscores in front."""
    name, w_, hits_ = (free_name(docs.columns, c) for c in ("license", "_w", "_hits"))
    idf = idf_table(docs, templates)
    index = {t.label: rare_words(t, idf) for t in templates}
    indexed = sorted({w for posts in index.values() for w, _ in posts})
    d = docs.withColumn(w_, word_array(F.col("text")))
    hits = F.filter(F.transform(w_, lambda w, i: F.when(F.lower(w).isin(indexed), F.struct(
        F.translate(w, UPPER, LOWER).alias("w"), i.cast("int").alias("at")))), lambda h: h.isNotNull())
    d = d.withColumn(hits_, hits)

    def proposed(word: str, place: int) -> Column:
        return F.transform(F.filter(hits_, lambda h: h["w"] == word), lambda h: h["at"] - F.lit(place))

    def starts(t: Template) -> Column:
        found, posts = None, index[t.label]
        same = len({w for w, _ in posts}) < len(posts)  # one repeated word: any of its places may be it
        for w, i in posts:
            here = proposed(w, i)
            found = here if found is None else F.array_union(found, here) if same else F.array_intersect(found, here)
        words, n = t.text.split(), len(t.text.split())
        keys = [(k.split(), _at(words, k.split())) for k in (t.keys or (t.text,))]

        def verified(s):
            ok = s >= 0
            for k, at in keys:
                ok = ok & (ascii_lower(F.slice(w_, s + (at + 1), F.lit(len(k)))) == F.array(*map(F.lit, k)))
            return ok

        total = sum(idf[w] for w in words)
        weights = F.array(*[F.lit(idf[w] / total) for w in words])

        def place(s):
            own = ascii_lower(F.slice(w_, s + 1, F.lit(n)))
            score = F.aggregate(F.zip_with(F.zip_with(own, F.array(*map(F.lit, words)), lambda a, b: a == b), weights,
                                           lambda same, x: F.when(same, x).otherwise(F.lit(0.0))),
                                F.lit(0.0), lambda a, x: a + x)
            return F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("start"),
                            F.least(score, F.lit(1.0)).alias("score"), F.lit(t.base).alias("base"))

        return F.transform(F.filter(found, verified), place)

    none = "array<struct<label:string,start:bigint,score:double,base:boolean>>"
    places = F.when(F.size(hits_) == 0, F.array().cast(none)).otherwise(F.concat(*[starts(t) for t in templates]).cast(none))
    return (d.withColumn(name, F.struct(F.size(w_).cast("long").alias("n_words"), places.alias("places")))
            .drop(w_, hits_))


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


@register("op1_license_scan")
def op1(spark, sf_dir):
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.select("doc_id", "license.n_words", F.col("license.places").alias("p"))
    d = d.withColumn("b", F.filter("p", lambda x: x["base"]))

    def names(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    at = F.transform("b", lambda x: x["start"])
    return d.select("doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
                    F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                    names(F.col("b")).alias("base_labels"), names(F.col("p")).alias("labels"),
                    F.coalesce(F.array_max(F.transform("p", lambda x: x["score"])), F.lit(0.0)).alias("score"))
