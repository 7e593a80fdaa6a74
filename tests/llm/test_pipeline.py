"""The corpus pipeline against a brute-force version of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb

from pricewise.session import ship_package
from test_operators import brute_components, fingerprint, holds_item, words


def test_pipeline_keeps_what_brute_force_keeps(spark, sf_dir):
    ship_package(spark)
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by 1").fetchall()
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    first, kept = {}, []
    for (i, t), r in zip(rows, brute_components([fingerprint(t) for _, t in rows])):
        if r not in first:
            first[r] = i
            kept.append((i, words(t)))
    count = Counter(tuple(w[s:s + 35]) for _, w in kept for s in range(len(w) - 34))
    left = {}
    for i, w in kept:
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s:s + 35])] > 1:
                gone[s:s + 35] = [True] * 35
        if not all(gone):
            left[i] = any(gone)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = {r.doc_id for r in out}
    assert got <= set(left) and all(r.round_trip for r in out)
    assert len(out) == len(got) and len(got) >= 0.9 * len(left)


def test_pipeline_gives_the_texts_that_brute_force_gives(spark, sf_dir):
    """The exact documents, decontamination included, and the pieces of their
    (shortened) texts."""
    import sentencepiece
    from pricewise.llm import sentencepieces
    ship_package(spark)
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by 1").fetchall()
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    kept = {}
    for (i, t), r in zip(rows, brute_components([fingerprint(t) for _, t in rows])):
        kept.setdefault(r, (i, t, words(t)))
    count = Counter(tuple(w[s:s + 35]) for _, _, w in kept.values() for s in range(len(w) - 34))
    left = {}
    for i, t, w in kept.values():
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s:s + 35])] > 1:
                gone[s:s + 35] = [True] * 35
        if not all(gone):
            left[i] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t
    items = [t for t, in duckdb.sql(f"select text from '{sf_dir}/benchmark.parquet'").fetchall()]
    clean = {i: t for i, t in left.items() if not any(holds_item(t, item) for item in items)}
    assert len(clean) < len(left)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.vocabulary("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) == len(clean)
    assert {r.doc_id: list(r.piece_ids) for r in out} == {i: library.encode(t) for i, t in clean.items()}


def test_stage_names_and_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
