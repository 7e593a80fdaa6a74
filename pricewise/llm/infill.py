"""Fill-in-the-middle transformation of whole texts.

A text is a run of units, each a maximal run of ASCII letters or one other code
point.  One ``fullmatch`` of ``(unit)*`` keeps every repetition of its group, so
``ends(1)`` alone gives the number of units and both offsets at which the text
is cut into prefix, middle and suffix.  A hash of the id picks the two units and
the form: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
``plain``, the text as it is.  Only the offsets come back from Python; the
output is put together by column functions.

A text above ``PIECE`` code points is matched piece by piece (a piece ends where
a unit ends), so that memory does not grow with the longest text.

Results in special cases: a null text is an empty one; an empty text has no
unit and is plain; a text that holds one of the three marks is plain; a null id
is hashed as an empty one, and rows that share an id share its draw; equal rows
give equal rows; an empty table gives no rows.  The input row is kept whole in
one struct column, so that none of its names can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.llm.registry import register, table

MARKS = ("<P>", "<S>", "<M>")
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20      # of the texts that are not plain
PIECE = 1 << 20       # code points matched at a time

UNITS = regex.compile("([A-Za-z]++|[^A-Za-z])*+")
LETTERS = regex.compile("[A-Za-z]*+")


def unit_ends(text: str, piece: int = PIECE) -> np.ndarray:
    """Where every unit of ``text`` ends, in code points."""
    if len(text) <= piece:
        return np.array(UNITS.fullmatch(text).ends(1), dtype=np.int64)
    parts, at = [], 0
    while at < len(text):
        to = min(len(text), at + piece)
        if text[to - 1].isascii() and text[to - 1].isalpha():
            to = LETTERS.match(text, to).end()  # the rest of the run
        parts.append(np.array(UNITS.fullmatch(text, at, to).ends(1), dtype=np.int64))
        at = to
    return np.concatenate(parts)


def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of every text and the code points before the smaller and the
    larger of the units drawn by two hashes."""
    n, first, second = (np.zeros(len(text), dtype=np.int64) for _ in range(3))
    draws = zip(one.to_pylist(), two.to_pylist())
    for i, (words, (a, b)) in enumerate(zip(text, draws)):
        ends = unit_ends(words.as_py() or "")
        n[i] = len(ends)
        a, b = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
        first[i] = ends[a - 1] if a else 0
        second[i] = ends[b - 1] if b else 0
    return pa.StructArray.from_arrays([pa.array(n), pa.array(first), pa.array(second)], names=["n", "first", "second"])


def output(text: Column, form: Column, first: Column, second: Column) -> Column:
    """The text in its form, cut after ``first`` and ``second`` code points."""
    p, s, m = map(F.lit, MARKS)
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    return (F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
            .when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from.  No mark is in such
    a text, and none arises where a text and a mark meet, as marks begin and
    end with characters that occur nowhere else in them."""
    parts = F.split(output, "|".join(MARKS), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``document`` (the input row, a struct) and ``infill``, a struct of n,
    form, prefix_chars, middle_chars (null if plain) and output."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("document.doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = (docs.select(row.alias("document"))
            .select("document", digest.alias("digest"), F.coalesce(F.col("document.text").cast("string"), F.lit("")).alias("whole"))
            .select("document", "whole", F.struct(*[d.alias(f"h{i}") for i, d in enumerate(draw, 1)]).alias("draw")))
    whole = F.col("whole")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(whole, F.lit(m))
    plain = (whole == "") | marked | (F.col("draw.h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("draw.h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut_at = F.arrow_udf(cuts, "struct<n:long,first:long,second:long>")
    cut = rows.select("document", "whole", form.alias("form"), cut_at("whole", "draw.h1", "draw.h2").alias("cut"))
    first, second = F.col("cut.first"), F.col("cut.second")
    made = F.col("form") != "plain"
    return cut.select("document", F.struct(
        F.col("cut.n").alias("n"), F.col("form").alias("form"),
        F.when(made, first).alias("prefix_chars"), F.when(made, second - first).alias("middle_chars"),
        output(whole, F.col("form"), first, second).alias("output")).alias("infill"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
e AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


@register("op11_fill_in_middle", ORACLE)
def op11(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("document.doc_id", "infill.*")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                       F.sha2(F.encode(restore(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"))
