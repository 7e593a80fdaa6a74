"""A training-corpus pipeline over ``documents`` out of five operators.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns the documents that stay (all columns of its input, texts possibly
shortened); the last one returns the encoded corpus.  Each stage sees all that
the stage before kept.

* language: documents whose language is not recognised (no letter) go.
* near_duplicates: of each group of near copies the document with the smallest
  id stays; rows that repeat that id count once; rows without an id stay.
* substrings: words covered by passages of 35 words or more that occur more
  than once go; a document left without a word goes; one that loses nothing
  keeps its text byte for byte.
* decontamination: documents that contain a benchmark item go.
* pieces: texts become SentencePiece ids, with a check that decoding gives the
  text back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm import decontaminate, langid, neardup, sentencepieces, substrings
from pricewise.session import shared_folder, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = langid.identify(docs)
    return found.where(found[found.columns[-1]]["lang_pred"] != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neardup.keep_one(docs)


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.match(docs, benchmark)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return (sentencepieces.encode_documents(docs.select("doc_id", "lang", "source", "text"))
            .select("doc_id", "lang", "source", "n_pieces", "round_trip", "piece_ids"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", remove_substrings),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

ORACLE_SQL = None  # trained models and components: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written as
    Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
