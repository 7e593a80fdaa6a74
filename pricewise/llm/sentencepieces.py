"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (dummy prefix
and white-space escape of an identity rule), the piece lexicon as a prefix
tree, and byte fallback for characters without a piece.  A text is composed
with them segment by segment, and the segment's pieces are the shortest path
of the resulting lattice in the tropical semiring.

* Unigram models weight an arc with the piece's negative score.
* BPE models have no additive piece weights: the result is fixed by the order
  of merges.  Here the weight of an arc depends on the piece before it: 0 if
  the two, joined and merged afresh, come out as the same two pieces, else
  infinity.  Exactly one path then has finite weight.  Pair weights are
  computed once per pair and kept.

Segments are cut where no piece can cross: before a run of escaped spaces and
around characters that occur in no piece, so composition is memoised on
segments (bounded per worker).

Results in special cases: a null text gives null ids and null decoded text; an
empty text gives no ids; very long runs are one linear pass; the escape
character U+2581 in a text decodes to a space, as in the library; equal rows
give equal rows; other columns are kept.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm.merging import PairTable, merge_rows
from pricewise.llm.registry import free_name, register, table

SPACE = "▁"
CACHE = 100_000  # remembered segments per worker
ROWS = 500          # texts encoded at a time
LONG = 48           # characters; longer segments are composed one by one
PAIR_BITS = 20      # of the table of known pair weights (forgotten when half full)
UNIGRAM, BPE = 1, 2


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and normaliser flags of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only identity normalisation with a leading escape is compiled here")
    kinds = pb.ModelProto.SentencePiece
    return {"pieces": [p.piece for p in proto.pieces], "scores": [p.score for p in proto.pieces],
            "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE},
            "usable": [p.type in (kinds.NORMAL, kinds.USER_DEFINED) for p in proto.pieces],
            "hidden": [p.type in (kinds.CONTROL, kinds.UNKNOWN) for p in proto.pieces],
            "unk": trained.unk_id, "kind": trained.model_type, "dummy": norm.add_dummy_prefix}


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, spec: dict):
        self.kind, self.dummy = spec["kind"], spec["dummy"]
        self.pieces = spec["pieces"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if spec["usable"][i]}
        self.scores = spec["scores"]
        self.bytes = spec["bytes"]
        self.unk = spec["unk"]
        self.lexicon: dict = {}
        for piece, i in self.ids.items():
            node = self.lexicon
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = i
        letters = {ch for piece in self.ids for ch in piece}
        apart = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in letters)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # no piece crosses these cuts (a model with inner escapes is composed whole)
        self.cut = re.compile(f"[^{SPACE}{apart}]+|{SPACE}+[^{SPACE}{apart}]*|[{apart}]" if not crossing else "(?s:.+)").findall
        worth = min(self.scores) - 10.0  # weight of an unknown character in a unigram lattice
        self.unknown_weight = -worth
        # decoding: what each id writes
        self.writes = [b"" if spec["hidden"][i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            self.writes[i] = bytes([b])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = {ch: i + 1 for i, ch in enumerate(sorted(letters))}  # 0: in no piece
        self.letter_of = np.zeros(0x110000, dtype=np.int32)
        self.letter_of[[*map(ord, self.letters)]] = [*self.letters.values()]
        self.letter_whole = np.array([False, *(ch in self.ids for ch in sorted(letters))])
        if self.kind == BPE:
            self.compile_merges()
            self.compile_lexicon()
            self.lexicon = {}  # the table has it all

    # ---- normaliser
    def normalise(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy and text else text

    # ---- byte fallback
    def fallback(self, ch: str) -> list[int]:
        if not self.bytes:
            return [self.unk]
        return [self.bytes[b] for b in ch.encode()]

    # ---- arc weights of a BPE model
    def compile_merges(self) -> None:
        """Every way to join two pieces into a third, ranked by score."""
        found, made = [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    found.append(a << 32 | b)
                    made.append(i)
        rank = {x: r for r, x in enumerate(sorted({self.scores[i] for i in made}, reverse=True))}
        ranks = np.array([rank[self.scores[i]] for i in made], dtype=np.int32)
        bits = max(10, (2 * len(found)).bit_length() + 1)
        self.merges = PairTable(np.array(found, dtype=np.int64), ranks, np.array(made, dtype=np.int32), bits)
        width = max(map(len, self.ids))
        self.spelled = np.full((len(self.pieces), width), -1, dtype=np.int32)  # characters as pieces
        self.lens = np.zeros(len(self.pieces), dtype=np.int64)
        for piece, i in self.ids.items():
            self.spelled[i, :len(piece)] = [self.ids.get(ch, -1) for ch in piece]
            self.lens[i] = len(piece)
        self.forget()
        every = np.array(sorted(self.ids.values()))
        rows, n = merge_rows(self.spelled[every], self.lens[every], self.merges)
        self.whole = np.zeros(len(self.pieces), dtype=bool)  # the piece's own characters merge to it
        self.whole[every] = (n == 1) & (rows[:, 0] == every)

    def forget(self) -> None:
        self.known = PairTable(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), PAIR_BITS)
        self.n_known = 0

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether arc b has weight 0 after arc a (pairs of pieces; a < 0:
        nothing before that could merge)."""
        free = self.whole[b].copy()
        at = np.flatnonzero(a >= 0)
        a, b = a[at], b[at]
        slot = self.known.find(a, b)
        new = np.unique((a.astype(np.int64) << 32 | b)[self.known.key[slot] < 0])
        if len(new):
            if 2 * (self.n_known + len(new)) > len(self.known.key):
                self.forget()
                new = np.unique(a.astype(np.int64) << 32 | b)
            self.learn(new)
            slot = self.known.find(a, b)
        free[at] = self.known.made[slot] == 1
        return free

    def learn(self, pairs: np.ndarray) -> None:
        """Join and merge the characters of the pairs: weight 0 if the same
        two pieces come out."""
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        na, total = self.lens[a], self.lens[a] + self.lens[b]
        joined = np.full((len(pairs), int(total.max())), -1, dtype=np.int32)
        cols = np.arange(joined.shape[1])
        inside = np.arange(self.spelled.shape[1])
        left = cols < na[:, None]
        joined[left] = self.spelled[a][inside < na[:, None]]
        joined[~left & (cols < total[:, None])] = self.spelled[b][inside < (total - na)[:, None]]
        rows, n = merge_rows(joined, total, self.merges)
        same = (n == 2) & (rows[:, 0] == a) & (rows[:, 1] == b)
        self.known.insert(pairs, np.zeros(len(pairs), np.int32), same.astype(np.int32))
        self.n_known += len(pairs)

    # ---- composition and shortest path of segments
    def compile_lexicon(self) -> None:
        """The prefix tree as a transition table (node, letter) -> node."""
        keys, to, accepts = [], [], [-1]
        todo = [(self.lexicon, 0)]
        while todo:
            node, at = todo.pop()
            for ch, child in node.items():
                if ch:
                    accepts.append(child.get("", -1))
                    keys.append(at << 32 | self.letters[ch])
                    to.append(len(accepts) - 1)
                    todo.append((child, len(accepts) - 1))
        bits = max(10, (2 * len(keys)).bit_length() + 1)
        self.moves = PairTable(np.array(keys, dtype=np.int64), np.zeros(len(keys), np.int32),
                               np.array(to, dtype=np.int32), bits)
        self.accepts = np.array(accepts, dtype=np.int32)

    def bpe_paths(self, segments: list[str]) -> list[bytes]:
        """The path of finite weight of each segment, all in step: place by
        place, every segment's arcs of weight 0 are entered."""
        n = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        width = int(n.max())
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = np.zeros((width + 1, len(segments)), dtype=np.int64)  # one row per place
        inside = np.arange(width)[:, None] < n
        letter.T[:, :width][inside.T] = self.letter_of[codes]
        none, start, fallback = -3, -2, -1
        piece = np.full((width + 1, len(segments)), none, dtype=np.int32)  # the finite arc into each place
        piece[0] = start
        moves, accepts = self.moves, self.accepts
        for i in range(width):
            rows = np.flatnonzero((n > i) & (piece[i] != none))
            node, before = np.zeros(len(rows), dtype=np.int64), piece[i, rows]
            for k in range(i, width):  # letter 0 (a text's end, an unknown character) has no move
                slot = moves.find(node, letter[k, rows])
                ok = np.flatnonzero(moves.key[slot] >= 0)
                if not len(ok):
                    break
                rows, before, node = rows[ok], before[ok], moves.made[slot[ok]].astype(np.int64)
                ends, into = accepts[node], piece[k + 1]
                try_ = np.flatnonzero((ends >= 0) & (into[rows] == none))
                if len(try_):
                    free = try_[self.follows(before[try_], ends[try_])]
                    into[rows[free]] = ends[free]
            lost = (n > i) & (piece[i] != none) & (piece[i + 1] == none)
            lost &= ~self.letter_whole[letter[i]]
            piece[i + 1, lost] = fallback
        # all paths back at once, last piece first
        at, live, path = n.copy(), np.arange(len(segments)), []
        while len(live):
            p = piece[at[live], live]
            path.append((live, p, at[live]))
            at[live] -= np.where(p >= 0, self.lens[p], 1)
            live = live[at[live] > 0]
        seg = np.concatenate([x[0] for x in path])
        ids = np.concatenate([x[1] for x in path])
        end = np.concatenate([x[2] for x in path])
        order = np.lexsort((end, seg))
        seg, ids, end = seg[order], ids[order].astype("<i4"), end[order]
        cuts = np.searchsorted(seg, np.arange(len(segments) + 1)).tolist()
        raw = ids.tobytes()
        out = [raw[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]
        for s in np.unique(seg[ids < 0]).tolist():  # byte fallback
            full: list[int] = []
            for p, e in zip(ids[cuts[s]:cuts[s + 1]].tolist(), end[cuts[s]:cuts[s + 1]].tolist()):
                full.extend((p,) if p >= 0 else self.fallback(segments[s][e - 1]))
            out[s] = np.array(full, dtype="<i4").tobytes()
        return out

    def unigram_path(self, s: str) -> list[int]:
        n = len(s)
        cost, last = [0.0] + [math.inf] * n, [None] * (n + 1)
        last[0] = (-1, None)
        for i in range(n):
            node, k = self.lexicon, i
            while k < n:
                node = node.get(s[k])
                if node is None:
                    break
                k += 1
                piece = node.get("")
                if piece is not None and cost[i] - self.scores[piece] < cost[k]:
                    cost[k], last[k] = cost[i] - self.scores[piece], (i, piece)
            if s[i] not in self.ids and cost[i] + self.unknown_weight < cost[i + 1]:
                cost[i + 1], last[i + 1] = cost[i] + self.unknown_weight, (i, None)
        return self.back(s, last)

    def back(self, s: str, last: list) -> list[int]:
        out, k = [], len(s)
        while k > 0:
            i, piece = last[k]
            out.extend([piece] if piece is not None else self.fallback(s[i:k])[::-1])
            k = i
        return out[::-1]

    # ---- whole texts
    def learn_segments(self, segments: set[str]) -> None:
        """Shortest paths of segments not met lately, into the memory (two
        generations: what the older one holds is taken over when met)."""
        memo, older = self.memo, self.older
        new = segments.difference(memo)
        if len(memo) + len(new) > CACHE:
            self.older = older = memo
            self.memo = memo = {}
            new = segments
        again = new.intersection(older)
        memo.update((s, older[s]) for s in again)
        new = sorted(new.difference(again), key=len)
        if self.kind != BPE:
            memo.update((s, np.array(self.unigram_path(s), dtype="<i4").tobytes()) for s in new)
            return
        step = 1 << 14
        short = [s for s in new if len(s) <= LONG]
        for lo in range(0, len(short), step):
            memo.update(zip(short[lo:lo + step], self.bpe_paths(short[lo:lo + step])))
        for s in new[len(short):]:
            memo[s] = self.bpe_paths([s])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece ids of each text; texts are taken in parts of bounded size."""
        out: list = [None] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if text is None:
                continue
            held.append((i, self.cut(self.normalise(text))))
            size += len(held[-1][1])
            if size > 200_000:
                self.settle(held, out)
                held, size = [], 0
        self.settle(held, out)
        return out

    def settle(self, held: list, out: list) -> None:
        self.learn_segments(set().union(*(x for _, x in held)))
        get = self.memo.__getitem__
        for i, segments in held:
            out[i] = np.frombuffer(b"".join(map(get, segments)), dtype="<i4")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.writes.__getitem__, ids))
        return (raw[1:] if self.dummy and raw.startswith(b" ") else raw).decode(errors="replace")


_machines: dict[int, Transducer] = {}


def _machine(spec) -> Transducer:
    """One compiled machine per worker and model."""
    key = id(spec)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(spec)
        _machines[key].spec = spec
    return _machines[key]


def _lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
    offsets = pa.array(ends, pa.int32(), mask=np.array([x is None for x in ids] + [False]))
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, "<i4")])
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))


def codec(spark: SparkSession, path: str) -> tuple[Column, Column, Column]:
    """Column functions encode (text -> ids), decode (ids -> text) and both
    (text -> struct of piece_ids and decoded, in one pass)."""
    model = spark.sparkContext.broadcast(read_model(path))  # the model file bounds its size

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        return _lists(_machine(model.value).encode_all(text.to_pylist()))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        machine = _machine(model.value)
        return pa.array((machine.decode(x.as_py()) if x.is_valid else None for x in ids), pa.string())

    @F.arrow_udf("struct<piece_ids:array<int>,decoded:string>")
    def both(text: pa.Array) -> pa.Array:
        machine, parts = _machine(model.value), []
        for lo in range(0, max(1, len(text)), ROWS):  # few rows at a time: ids are long
            ids = machine.encode_all(text.slice(lo, ROWS).to_pylist())
            back = pa.array([None if x is None else machine.decode(x.tolist()) for x in ids], pa.string())
            parts.append(pa.StructArray.from_arrays([_lists(ids), back], names=["piece_ids", "decoded"]))
        return pa.concat_arrays(parts)

    return encode, decode, both


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs``, then three more: piece_ids, n_pieces and
    round_trip (decoding gives the text back); a name that is taken gets
    underscores in front."""
    both = codec(docs.sparkSession, path or vocabulary("piece_bpe_32k.model"))[2]
    found = both(F.col("text").cast("string"))
    ids, n, same = (free_name(docs.columns, c) for c in ("piece_ids", "n_pieces", "round_trip"))
    return docs.withColumns({ids: found["piece_ids"],
                             n: F.coalesce(F.size(found["piece_ids"]), F.lit(0)).cast("long"),
                             same: found["decoded"].eqNullSafe(F.col("text").cast("string"))})


@register("op3_sentencepiece_codec")
def op3(spark, sf_dir):
    docs = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_pieces", "round_trip", "piece_ids")
