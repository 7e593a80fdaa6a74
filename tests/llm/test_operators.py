"""Each operator's registered query against a brute-force version on the small
tables, and the special cases that the docstrings promise."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from pricewise.llm import (buckets, codelength, decontaminate, langid, licenses, linecrf, neardup, ppm, registry,
                           sentencepieces, sharding, substrings, textkernel, tokencount)
from pricewise.session import ship_package

registry.load_all()
WORD = re.compile("[^\x20\x09-\x0D]+")
EDGE = [(1, None, "en", "a"), (2, "", None, "b"), (2, "", None, "b"), (3, "  \n\t ", "de", None), (None, "one two three", "en", "a"),
        (4, "MIT License. The Apache License; cc by", "en", "a"), (5, "x " * 3000, "en", "a"), (6, "x " * 3000, "en", "a"),
        (7, "é漢字 🙂 " * 40, "fr", "b"), (8, "12345 !!! 67", "en", "c")]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"select doc_id, text, lang from '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, blanks, long and repeated rows, and columns whose names clash."""
    rows = [(*r, 1, "s", 0.5) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slice int, matches string, n double")


def run(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).collect()


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_licenses(spark, sf_dir, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = {r.doc_id: r for r in run(spark, sf_dir, "op1_license_scan")}
    for i, text, _ in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(s, lab) for p, lab in phrases.items() for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_edges(edge):
    out = licenses.scan(edge).collect()
    assert len(out) == len(EDGE)
    assert {p.label for r in out if r.doc_id == 4 for p in r.license.places} >= {"mit", "apache", "cc-by"}
    assert all(r.license.n_words == 0 for r in out if r.doc_id in (1, 2, 3))


def fingerprint(text):
    w = words(text, lower=True)
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    f = np.array(prints, dtype=np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_simhash(spark, sf_dir, docs):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op2_simhash_near_dedup")}
    prints = [fingerprint(t) for _, t, _ in docs]
    root = brute_components(prints)
    least = {}
    for (i, _, _), r in zip(docs, root):
        least[r] = min(least.get(r, i), i)
    for (i, _, _), p, r in zip(docs, prints, root):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", least[r])


@pytest.mark.parametrize("cell_rows", [4, 1 << 15])
def test_trie_join_finds_every_link(spark, cell_rows):
    """Chains of close fingerprints, in whole and in cut cells."""
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = neardup.links(spark.createDataFrame(signed, "fp long"), 3, 3, cell_rows)
    got = {r.u: r.root for r in neardup.components(edges).collect()}
    brute = brute_components(prints)
    ours = [got.get(s[0], s[0]) for s in signed]
    pairs = {}
    for a, b in zip(brute, ours):
        assert pairs.setdefault(a, b) == b
    assert len(set(ours)) == len(set(brute))


@pytest.mark.parametrize("max_bits", [1, 4, 6])
def test_trie_join_finds_links_with_a_bit_in_every_block(spark, max_bits):
    """Pairs whose bits differ in as many places as allowed, spread out evenly."""
    rng = random.Random(max_bits)
    near = sum(1 << (64 * i // max_bits + 5) for i in range(max_bits))
    bases = [rng.getrandbits(64) for _ in range(30)]
    signed = [(p - (1 << 64) if p >> 63 else p) for b in bases for p in (b, b ^ near)]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for cell_rows in (4, 1 << 15):
        got = {r.u: r.root for r in neardup.components(neardup.links(frame, max_bits, 3, cell_rows)).collect()}
        assert all(got.get(a, a) == got.get(b, b) for a, b in zip(signed[::2], signed[1::2]))
        assert len({got.get(p, p) for p in signed}) == 30


def test_simhash_edges(edge):
    out = neardup.near_duplicates(edge).collect()
    assert len(out) == len(EDGE)
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}  # fingerprint zero links
    kept = sorted((r.doc_id is None, r.doc_id) for r in neardup.keep_one(edge).collect())
    assert [k for k in kept if not k[0]] == [(False, i) for i in (1, 4, 5, 7, 8)] and sum(k[0] for k in kept) == 1
    assert neardup.near_duplicates(edge.limit(0)).count() == 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    rows = [(1, one), (5, one), (5, two), (7, two), (9, two), (9, three), (9, three), (4, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(frame).collect()]
    assert sorted(k for k in kept if k[0] != 4) == [(1, one), (5, two), (9, three)]
    assert [k[0] for k in kept].count(4) == 1
    both = spark.createDataFrame([(3, one), (3, two), (8, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(both).collect()) == [(3, one), (3, two)]


def test_sentencepieces_equal_the_library(docs):
    import sentencepiece
    path = sentencepieces.vocabulary("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Transducer(sentencepieces.read_model(path))
    rng = random.Random(1)
    parts = ["a", "er", " ", "  ", "the", "\n", "\t", "<s>", "é", "漢", " 12", "!", "🙂", "    ", "　", "and"]
    texts = [t for _, t, _ in docs if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(500)]
    texts += ["", " ", "a" * 2000, " " * 300]
    for text, ids in zip(texts, own.encode_all(texts)):
        want = library.encode(text)
        assert ids.tolist() == want
        assert own.decode(want) == library.decode(want)


def test_sentencepiece_edges(edge):
    out = sentencepieces.encode_documents(edge).collect()
    assert len(out) == len(EDGE) and all(r.round_trip for r in out)
    assert out[0].piece_ids is None and out[1].piece_ids == []


def test_decontamination(spark, sf_dir, docs):
    got = {(r.doc_id, r.item_id) for r in run(spark, sf_dir, "op4_benchmark_decontamination")}
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()

    def plain(t):
        return " " + " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) + " "
    texts = {i: plain(t) for i, t, _ in docs}
    want = {(d, i) for i, t in items for d, s in texts.items() if plain(t) in s}
    assert want <= got
    for d, i in got - want:  # anything further must be a close paraphrase
        item, text = plain(dict(items)[i]).split(), texts[d].split()
        masks = {}
        for k, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontaminate.common_subsequence(masks, len(item), text) >= 0.5 * len(item)


def test_decontamination_paraphrase_and_edges(spark, edge):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(60)]
    item = "".join(f"zq{i} " for i in range(30)).split()
    close = [w if i % 6 else "changed" for i, w in enumerate(item)]
    texts[7] += " " + " ".join(close)
    texts[9] += " " + " ".join(item).upper()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    hits = decontaminate.match(frame, bench).where("size(matches) > 0").collect()
    assert {(r.doc_id, m.item_id) for r in hits for m in r.matches} == {(7, 1), (9, 1)}
    own = decontaminate.match(edge, bench)
    assert own.columns == [*edge.columns, "_matches"] and {r.matches for r in own.collect()} == {"s"}
    assert decontaminate.match(frame, bench.limit(0)).where("size(matches) > 0").count() == 0


def test_decontamination_finds_copies_of_long_items(spark):
    """Items far longer than a passage, copied whole into other text; the last
    one alone in its block."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    items = {i: [f"q{i}w{k}" for k in range(n)] for i, n in enumerate([40, 65, 330, 600, 9000])}
    texts = [" ".join(rng.choice(plain) for _ in range(200)) for _ in range(40)]
    for i, item in items.items():
        texts[3 * i] += " " + " ".join(item) + " " + " ".join(rng.choice(plain) for _ in range(100))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    hits = decontaminate.match(frame, bench).where("size(matches) > 0").collect()
    assert {(r.doc_id, m.item_id, m.lcs_share, m.answer) for r in hits for m in r.matches} == {(3 * i, i, 1.0, True) for i in items}


def holds_item(text, item):
    """Does a text hold a benchmark item, passage by passage?"""
    words, item = (re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in (text, item))
    n, masks = len(item), {}
    if not n or 2 * sum((Counter(item) & Counter(words)).values()) < n:
        return False
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    for width, stride in decontaminate.PASSAGES:
        for lo in range(0, max(1, len(words) - width + stride), stride):
            w = words[max(0, lo - n // 2):lo + width + n // 2]
            share = decontaminate.common_subsequence(masks, n, w) / n
            stands = " ".join(item[-decontaminate.ANSWER_WORDS:]) in " ".join(w)
            if share >= decontaminate.MIN_SHARE or share >= decontaminate.MIN_PARAPHRASE and stands:
                return True
    return False


def test_decontamination_candidates_miss_nothing(spark, sf_dir, docs):
    """Every item with every document, passage by passage, without the cosine."""
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    want = {(d, i) for i, t in items for d, text, _ in docs if holds_item(text, t)}
    assert want == {(r.doc_id, r.item_id) for r in run(spark, sf_dir, "op4_benchmark_decontamination")} and want


def test_decontamination_does_not_depend_on_the_items_beside(spark):
    """A stretched copy: a third of the words of any passage are the item's."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    item = [f"zq{i}" for i in range(60)]
    stretched = [w for x in item[:-5] for w in (x, rng.choice(plain), rng.choice(plain))] + item[-5:]
    texts = [" ".join(rng.choice(plain) for _ in range(200)) for _ in range(30)]
    texts[7] += " " + " ".join(stretched)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for beside in ([], [(2, "kx ky kz kv kw")]):
        bench = spark.createDataFrame([(1, " ".join(item)), *beside], "item_id long, text string")
        hits = decontaminate.match(frame, bench).where("size(matches) > 0").collect()
        assert {(r.doc_id, m.item_id) for r in hits for m in r.matches} == {(7, 1)}


def test_language(spark, sf_dir, docs):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op5_language_id")}
    held = [(i, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)


def test_language_edges(edge):
    out = {(r.doc_id, r.text): r.language for r in langid.identify(edge).collect()}
    assert out[(1, None)].lang_pred == out[(8, EDGE[-1][1])].lang_pred == langid.UNKNOWN
    assert out[(4, EDGE[5][1])].lang_pred in ("en", "fr", "de")
    assert all(r.language.lang_pred == langid.UNKNOWN for r in langid.identify(edge, edge.limit(0)).collect())


def test_code_lengths_are_a_distribution_and_equal_ppm():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcab ") for _ in range(60)) for _ in range(20)]
    grams = Counter()
    for t in texts:
        p = bytes([ppm.PAD]) * 3 + t
        grams.update(int.from_bytes(p[i:i + 4], "big") for i in range(len(t)))
    gram, n = np.array(list(grams)), np.array(list(grams.values()))
    trie = ppm.Trie.whole(gram, n)
    for cost in trie.code_lengths():
        assert np.allclose(np.exp(-cost).sum(axis=1), 1.0)

    def brute(context, symbol):
        out, cost = set(), 0.0
        for order in (3, 2, 1, 0):
            seen = Counter()
            for g, c in grams.items():
                if (g >> 8) & ((1 << 8 * order) - 1) == int.from_bytes(context[3 - order:], "big"):
                    seen[g & 255] += c
            left = {s: c for s, c in seen.items() if s not in out}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return cost + math.log(total / left[symbol])
            cost += math.log(total / len(left))
            out |= set(left)
        return cost + math.log(256 - len(out))
    tables = ppm.Tables([trie])
    for text in (b"abc", b"zab  c", b"q"):
        p = bytes([ppm.PAD]) * 3 + text
        want = sum(brute(p[i:i + 3], p[i + 3]) for i in range(len(text)))
        got = tables.costs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0]
        assert got == pytest.approx(want, rel=1e-5)


def test_token_counts_equal_the_library(spark, sf_dir, docs):
    from tokenizers import Tokenizer
    path = tokencount.vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokencount.Counter(tokencount.load(path))
    got = {r.doc_id: r for r in run(spark, sf_dir, "op6_token_counts")}
    for i, t, _ in docs:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    odd = ["a" + chr(c) + "b " + chr(c) * 2 for c in range(1, 0x3100)] + ["x<|endoftext|> y<|endoftext|><|endoftext|>", "ab" * 3000, ""]
    assert own.counts(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]
    assert own.counts([None]) == [0]


def test_quality_rules(spark, sf_dir, docs):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op7_quality_rules")}
    for i, text, _ in docs:
        text = text or ""
        w = WORD.findall(text)
        c = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        covered = [any(c[tuple(w[j:j + 3])] > 1 for j in range(max(0, k - 2), min(k, len(w) - 3) + 1)) for k in range(len(w))]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = sum(covered)
        failed = len(w) < 50 or 100 * n > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, n, failed)
        assert not (failed and r.kept)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    crf = linecrf.LineCrf(rng.normal(size=linecrf.FEATURES), rng.normal(size=(2, 2)))
    lines = [3, 1, 5]
    features = rng.normal(size=(sum(lines), linecrf.FEATURES))
    label = crf.viterbi(features, np.repeat(np.arange(3), lines))
    at = 0
    for n in lines:
        s = features[at:at + n] @ crf.weights

        def value(path):
            return sum(s[k] for k in range(n) if path[k]) + sum(crf.moves[path[k - 1], path[k]] for k in range(1, n))
        best = max(([(b >> k) & 1 for k in range(n)] for b in range(1 << n)), key=value)
        assert label[at:at + n].tolist() == best
        at += n


def test_quality_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = {r.doc_id: r.quality_rules for r in linecrf.judge(edge, none).collect()}
    assert out[1].n_words == 0 and out[1].base_failed and not out[1].kept


def test_lm_scores(spark, sf_dir, docs):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op8_lm_scoring")}
    count, tokens = Counter(), {}
    for i, t, _ in docs:
        tokens[i] = [*words(t, lower=True), None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


@pytest.mark.parametrize("key_bits", [2, 64])
def test_word_counts_with_a_weak_first_hash(spark, key_bits):
    """Words that meet under one key are counted apart."""
    from pyspark.sql import functions as F
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "cc", "ddd", "é"]) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    got = codelength.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 != 1, key_bits).collect()
    train = Counter(w for i, t in rows if i % 3 != 1 for w in [*words(t, lower=True), None])
    n, v = sum(train.values()), len(train)
    for r in got:
        own = [*words(dict(rows)[r.doc_id], lower=True), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))


def test_lm_edges(spark, edge):
    from pyspark.sql import functions as F
    out = codelength.score_documents(edge, F.col("doc_id") > 3).collect()
    assert len(out) == len(EDGE)
    assert all(r.n_tokens == 1 and r.score == 0 for r in out if r.doc_id in (1, 2))
    assert codelength.score_documents(edge.limit(0), F.lit(True)).count() == 0


def test_lm_scores_use_every_context(spark):
    """A varied corpus: far more order-3 contexts than common ones, rare ones
    included in the score."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+-_/=é漢") for _ in range(600)) for _ in range(120)]
    grams = Counter()
    for t in texts[:100]:
        p = bytes([ppm.PAD]) * 3 + t.encode()
        grams.update(int.from_bytes(p[i:i + 4], "big") for i in range(len(p) - 3))
    assert len({g >> 8 for g in grams}) > 20_000
    model = ppm.Tables([ppm.Trie.whole(np.array(list(grams)), np.array(list(grams.values())))])
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in codelength.score_documents(frame, F.col("doc_id") < 100).collect()}
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode(), np.uint8)
        assert got[i] == pytest.approx(-model.costs(b, np.array([0, len(b)]))[0, 0] / math.log(10), rel=1e-6)


def removed_by_brute_force(rows, width):
    count = Counter(tuple(w[s:s + width]) for _, w in rows for s in range(len(w) - width + 1))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s:s + width])] > 1:
                gone[s:s + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substrings(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in run(spark, sf_dir, "op9_substring_dedup"))
    assert got == sorted(removed_by_brute_force([(i, words(t)) for i, t, _ in docs], 35))


@pytest.mark.parametrize("width", [2, 5, 7])
def test_substring_widths(spark, width):
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    got = substrings.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert sorted(tuple(r) for r in got) == sorted(removed_by_brute_force([(i, words(t)) for i, t in rows], width))


@pytest.mark.parametrize("key_bits", [1, 4])
def test_substrings_with_a_weak_first_hash(spark, key_bits):
    """Windows that meet under one key are told apart by the other 64 bits."""
    rng = random.Random(key_bits)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = substrings.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"), 5, key_bits).collect()
    assert sorted(tuple(r) for r in got) == sorted(removed_by_brute_force([(i, words(t)) for i, t in rows], 5))


def test_input_columns_stay(spark, tmp_path):
    """Columns that have the names of results keep their values."""
    names = ["language", "quality_rules", "license", "_w", "_hits", "piece_ids", "n_pieces", "round_trip", "shard"]
    frame = spark.createDataFrame([(1, "an apache license here", "en", "a", *names), (2, None, None, None, *names)],
                                  "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [langid.identify(frame), linecrf.judge(frame, labels), licenses.scan(frame), sentencepieces.encode_documents(frame)]
    for out in results:
        assert out.columns[:len(frame.columns)] == frame.columns and len(set(out.columns)) == len(out.columns) > len(frame.columns)
        assert all(tuple(r)[4:4 + len(names)] == tuple(names) for r in out.collect())
    sharding.write_shards(frame, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard for r in back.collect()} == {"shard"} and "_shard" in back.columns


def test_license_template_of_repeated_words(spark):
    frame = spark.createDataFrame([(1, "x free free x free free free y")], "doc_id long, text string")
    (r,) = licenses.scan(frame, [licenses.Template("free", "free free")]).collect()
    assert [p.start for p in r.license.places] == [1, 4, 5]


def test_substring_edges(edge):
    out = substrings.remove_repeats(edge)
    assert out.columns == edge.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[4] == EDGE[5][1] and 5 not in kept and 6 not in kept and kept[1] is None
    assert substrings.repeat_digest(edge.limit(0)).count() == 0


def test_hilbert_curve(spark):
    from pyspark.sql import functions as F
    cells = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    rows = (spark.createDataFrame(cells, "x int, y int, z int")
            .withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect())
    assert [r.h for r in rows] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op10_hilbert_sharding")
    text = {i: (t or "").encode() for i, t, _ in docs}
    count = Counter(r.shard for r in got)
    assert len(got) == len(docs) and max(count.values()) - min(count.values()) <= 1 and len(count) == 40
    for s, n in count.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got)


def test_shard_edges(edge):
    out = sharding.shard(edge, 4).collect()
    assert len(out) == len(EDGE) and all(r.size == 16 and r.text_crc32 == 0 for r in out if r.doc_id in (1, 2))
    assert sharding.shard(edge.limit(0), 4).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(r[0], r[1], r[2], r[3]) for r in EDGE] + [(None, "another text", "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sharding.write_shards(frame, str(tmp_path / "out"), 4)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == [*frame.columns, "shard"]
    assert Counter(tuple(r)[:4] for r in out.collect()) == Counter(rows)
    sizes = Counter(r.shard for r in out.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 4


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 20, 40, 64):
        v = np.unique(rng.integers(0, 1 << bits, 300, dtype=np.uint64, endpoint=False) if bits < 64
                      else rng.integers(0, np.iinfo(np.uint64).max, 300, dtype=np.uint64))
        assert np.array_equal(buckets.unpack(buckets.pack(v), len(v)), v)


def test_word_hashes_depend_on_content_only():
    import pyarrow as pa
    col = pa.array(["ab cd", None, "", "cd  ab\nab", "é"])
    h, offs = textkernel.text_words(col)
    assert offs.tolist() == [0, 2, 2, 2, 5, 6]
    assert h[0] == h[3] == h[4] and h[1] == h[2] and h[0] != h[1]
