"""Fill-in-middle, document fingerprints and importance resampling against
brute force, and the special cases that their docstrings promise."""

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

from pricewise.llm import fingerprints, importance, infill, registry
from pricewise.session import ship_package

registry.load_all()
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [(1, None), (2, ""), (2, ""), (3, "  \n\t "), (None, "one two three"), (4, "marks <P> inside"), (5, "x " * 3000),
        (6, "x " * 3000), (7, "é漢字 🙂 " * 40), (8, "Zebra"), (9, "A\x00b\r\n<S"), (10, "<")]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "own", 0.5, "f", 7, 1.5) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, infill string, n double, form string, rank int, score double")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- fill in the middle

def cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), sha(out), sha(text)


def test_infill(spark, sf_dir, docs):
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()}
    assert got == {i: cut(i, t) for i, t in docs}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}


def test_infill_edges(edge):
    out = infill.fill_in_middle(edge)
    rows = out.select("document.*", infill.restore(out["infill.output"], out["infill.form"]).alias("back"),
                      out["infill.n"].alias("units"), out["infill.form"].alias("shape"), out["infill.output"].alias("made")).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert (r.infill, r.n, r.form) == ("own", 0.5, "f")  # columns of the input stay
        assert r.back == (r.text or "")
        assert (r.units, r["shape"], sha(r.made)) == tuple(cut(r.doc_id, r.text)[i] for i in (0, 1, 4))
    assert infill.fill_in_middle(edge.where("false")).count() == 0


def test_infill_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "Q", " ", "é", "longrunofletters", "\n"]) for _ in range(3000))
    whole = infill.unit_ends(text).tolist()
    assert whole == [m.end() for m in UNIT.finditer(text)]
    for piece in (1, 2, 7, 100):
        assert infill.unit_ends(text, piece).tolist() == whole


# -- fingerprints

def test_prefix_hashes_answer_spans():
    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(300)) + "🙂" + "ab" * 40
    h = fingerprints.PrefixHashes(fingerprints.code_points(text))
    for _ in range(2000):
        i, j = rng.randrange(len(text)), rng.randrange(len(text))
        n = rng.randrange(len(text) - max(i, j) + 1)
        assert h.equal(i, j, n) == (text[i:i + n] == text[j:j + n])
        same = next((k for k in range(len(text) - max(i, j)) if text[i + k] != text[j + k]), len(text) - max(i, j))
        assert fingerprints.common_extension(h, i, h, j) == same


def test_fingerprints_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc d") for _ in range(n)) for n in (0, 1, 15, 16, 23, 24, 25, 99, 100, 101, 350, 1000, 1024)]
    points = [fingerprints.code_points(t) for t in texts]
    want = fingerprints.fingerprints(points)
    for piece in (50, 100, 333):
        monkeypatch.setattr(fingerprints, "PIECE", piece)
        assert fingerprints.fingerprints(points) == want
    assert len(set(want)) == len(texts)


def test_edited_with_next(spark, sf_dir, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op12_document_fingerprints"](spark, sf_dir).collect()}
    order = sorted(docs, key=lambda r: -r[0])
    prints = {}
    assert len(got) == len(docs)
    for (i, text), (j, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + other[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(changed))
        own, new, following = (fingerprints.fingerprints([fingerprints.code_points(t)])[0] for t in (text, changed, other))
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), new.hex())
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, new), fingerprints.likeness(own, following))
        assert prints.setdefault(r.fingerprint, text) == text  # other texts, other fingerprints
        if text == other:
            assert r.near_next == 1
        if text == changed:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        elif len(text) > 200:
            assert 0.3 < r.near_edited <= 1


@pytest.mark.parametrize("parts", [1, 5])
def test_edited_edges(spark, edge, parts):
    """Nulls, ties and empty partitions: every row once, in a full circle."""
    many = edge.unionAll(spark.createDataFrame([(50, "same text again", *[None] * 5)] * 500, edge.schema))
    out = fingerprints.edit_with_next(many.repartition(parts)).collect()
    assert len(out) == len(EDGE) + 500
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    half = hashlib.sha256(b"same texsame te").digest()
    copies = Counter(r.edited_sha256 for r in out if r.doc_id == 50)
    assert copies[half] == 499 and len(copies) == 2  # one copy is followed by document 10
    (null,) = [r for r in out if r.doc_id is None]  # the last, so followed by the largest id
    assert null.edited_sha256 == hashlib.sha256(("one two three"[:7] + "same text again"[:6]).encode()).digest()


def test_edited_alone_and_empty(spark):
    one = spark.createDataFrame([("k", "hello world")], "doc_id string, text string")
    (r,) = fingerprints.edit_with_next(one).collect()
    assert (r.doc_id, r.near_next) == ("k", 1.0)
    assert r.edited_sha256 == hashlib.sha256(b"hello hello").digest()
    assert fingerprints.edit_with_next(one.where("false")).count() == 0


def test_fingerprint_columns(spark):
    base = "the quick brown fox jumps over the lazy dog while the cat looks on " * 6
    rows = [(base, base), (base, base + "and more"), (base, "nothing of the kind " * 20), ("", ""), ("", "a"), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(fingerprints.fingerprint(df.a).alias("a"), fingerprints.fingerprint(df.b).alias("b"),
                    fingerprints.beginning_in_common(df.a, df.b).alias("n"))
    like = [r[0] for r in out.select(fingerprints.fingerprint_likeness(out.a, out.b)).collect()]
    assert like[0] == 1 and like[1] > 0.6 and like[2] < 0.1 and like[3:] == [1, 0, 1]
    assert [r.n for r in out.collect()] == [len(base), len(base), 0, 0, 0, 0]


# -- importance resampling

def runs_of(text):
    w = WORD.findall(lower(text))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    runs = [(i, *runs_of(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in runs for f in fs)
    t = Counter(bucket(f) for x in target for f in runs_of(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, n, fs in runs:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, k) for k, r in enumerate(out) if r[1] >= least)
    rank = {k: n for n, (*_, k) in enumerate(able[:percent * len(able) // 100], 1)}
    return [(*r, rank.get(k)) for k, r in enumerate(out)]


def test_resampling(spark, sf_dir, docs):
    target = [r[0] for r in duckdb.sql(f"select text from '{sf_dir}/benchmark.parquet'").fetchall()]
    got = registry.QUERIES["op13_importance_resampling"](spark, sf_dir).collect()
    want = resampled(docs, target)
    assert len(got) == len(docs)
    assert {tuple(r) for r in got} == {(r[0], *r[2:]) for r in want}


def test_resampling_edges(spark, edge):
    target = spark.createDataFrame([("one two three x x",), (None,)], "text string")
    for of in (target, target.where("false")):
        got = importance.resample(edge, of, percent=50, least_words=1).collect()
        want = resampled(EDGE, [r.text for r in of.collect()], 50, 1)
        assert Counter(tuple(r)[:5] for r in got) == Counter(r[:5] for r in want)
        # documents 5 and 6 have one text but noise of their own; ranks are 1, 2, 3, ...
        assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[5] for r in want if r[5])
    assert importance.resample(edge.where("false"), target).count() == 0


def test_equal_rows_get_ranks_of_their_own(spark):
    rows = [(1, "word " * 30)] * 40 + [(2, "too short")] * 10
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7),
                              spark.createDataFrame([("word",)], "text string"), percent=25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    assert all(r["rank"] is None for r in got if r.doc_id == 2)


def test_run_crcs():
    """CRCs of runs from payloads, words of any length and bytes."""
    rng = random.Random(4)
    words = [rng.randbytes(rng.choice([1, 2, 9, 200, 255, 256, 257, 70_000])) for _ in range(60)]
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    length, of = np.array(list(map(len, words))), np.repeat([0, 1, 2], 20)
    for k, (begin, found) in enumerate(importance.features(crc, length, of), 1):
        want = [(i, zlib.crc32(b" ".join(words[i:i + k]))) for i in range(len(words) - k + 1) if of[i] == of[i + k - 1]]
        assert list(zip(begin.tolist(), found.tolist())) == want


@pytest.mark.parametrize("limit", [3, 1 << 17])
def test_automaton_payloads(limit):
    """Learned, forgotten and never learned words give the same payloads."""
    rng = random.Random(5)
    words, automaton = [f"w{i}" for i in range(12)] + ["é漢", "x" * 300, "a"], importance.Words(limit)
    for _ in range(20):
        picked = [rng.choice(words).encode() for _ in range(100)]
        text = b"  " + b" ".join(picked) + b" "
        _, crc, length = automaton.payloads(text)
        assert crc.tolist() == [zlib.crc32(w) for w in picked] and length.tolist() == list(map(len, picked))
    assert automaton.known
