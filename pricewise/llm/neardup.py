"""SimHash near-dedup by a binary-trie self-join.

Every text gets a 64-bit fingerprint over its word shingles (majority vote of
the shingles' XXH64 bits).  Fingerprints that differ in at most ``max_bits``
bits are linked, and a component of links is one group of near copies.

The join works on distinct fingerprints.  With ``max_bits`` = 3 two linked
fingerprints agree on one of four 16-bit blocks (with more bits allowed, on one
of more and shorter blocks), so each block in turn is rotated to the front as
the first levels of a binary trie, and the subtree
below each block value is a *cell*.  Inside a cell, pairs of trie nodes are
walked down together: the bits in which the two paths differ are added up and
a pair is dropped as soon as they exceed the budget.  A cell keeps a
union-find and gives back a spanning forest of its links, never all pairs.  A
cell that is too large for one task is itself cut at deeper trie nodes, and a
task gets one pair of nodes within the budget.

Components over all cells come from alternating large-star / small-star
rounds on the links.  Each round is checkpointed in ``spark.checkpoint.dir``.

Results in special cases: a null or blank text has fingerprint 0 and links
like any other; with fewer words than a shingle the whole sequence is the one
shingle; equal rows share fingerprint and component; null ids are left out of
the smallest id (component_id is null where a component has no id); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm import textkernel as K
from pricewise.llm.registry import register, table
from pricewise.session import cut_lineage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK_BITS = 16
TASK_ROWS = 1 << 17    # rows of one join task
CELL_ROWS = 1 << 15    # a larger cell is cut at deeper nodes
FRONTIER = 1 << 18     # node pairs held at once
LEAF = 32              # node pairs with at most so many members' pairs are compared directly


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes.lower changes A-Z only; bytes.split cuts at [\x20\x09-\x0D]
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.buffers(batch.column(1))
            raw = data.tobytes()
            o = offs.tolist()
            fp = np.fromiter((simhash(raw[a:b], shingle) for a, b in zip(o, o[1:])), dtype=np.uint64, count=len(o) - 1)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


class Forest:
    """Union-find over 0..n-1 that takes links in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.root[u], self.root[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_links(cell: np.ndarray, key: np.ndarray, max_bits: int, levels: int = 64,
               side: np.ndarray | None = None) -> np.ndarray:
    """Roots of the components of ``key`` (uint64) within equal ``cell``.

    Rows must be sorted by (cell, key).  The top ``64 - levels`` bits are
    taken as equal within a cell.  All cells are walked together, level by
    level.  Deep frontiers are worked off in parts, so memory stays bounded.
    """
    n = len(key)
    forest = Forest(n)
    edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.append(edge[1:], n)
    several = ends - edge > 1
    lo, hi = edge[several], ends[several]
    stack = [(levels - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((bit, *(x[half:] for x in (alo, ahi, blo, bhi, diff))))
            stack.append((bit, *(x[:half] for x in (alo, ahi, blo, bhi, diff))))
            continue
        na, nb = ahi - alo, bhi - blo
        leaf = (na * nb <= LEAF) | (bit < 0)
        if leaf.any():
            compare(forest, key, alo[leaf], na[leaf], blo[leaf], nb[leaf], max_bits)
            go = ~leaf
            alo, ahi, blo, bhi, diff = alo[go], ahi[go], blo[go], bhi[go], diff[go]
            if not len(alo):
                continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((key >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        c = ones[bit]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        parts = [(alo, am, blo, bm, diff, None), (am, ahi, bm, bhi, diff, None),
                 (alo, am, bm, bhi, diff + 1, None), (am, ahi, blo, bm, diff + 1, ~own)]
        nxt = []
        for pal, pah, pbl, pbh, pd, ok in parts:
            keep = (pah > pal) & (pbh > pbl) & (pd <= max_bits) & ~((pal == pbl) & (pah - pal == 1))
            if ok is not None:
                keep &= ok
            nxt.append(tuple(x[keep] for x in (pal, pah, pbl, pbh, pd)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*nxt))))
    return forest.root


def compare(forest: Forest, key, alo, na, blo, nb, max_bits: int, step: int = 1 << 20) -> None:
    """Compare the members of node pairs directly and link those in budget."""
    sizes = na * nb
    if len(sizes) and sizes.max() > step:  # deep nodes of many equal paths
        for i in np.flatnonzero(sizes > step):
            for r in range(0, int(na[i]), max(1, step // int(nb[i]))):
                m = min(max(1, step // int(nb[i])), int(na[i]) - r)
                u = np.repeat(np.arange(alo[i] + r, alo[i] + r + m), nb[i])
                v = np.tile(np.arange(blo[i], blo[i] + nb[i]), m)
                near = np.bitwise_count(key[u] ^ key[v]) <= max_bits
                forest.link(u[near], v[near])
        small = sizes <= step
        alo, na, blo, nb, sizes = alo[small], na[small], blo[small], nb[small], sizes[small]
    cut = np.cumsum(sizes) // step
    for part in range(int(cut[-1]) + 1 if len(cut) else 0):
        at = np.flatnonzero(cut == part)
        if not len(at):
            continue
        s = sizes[at]
        within = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        width = np.repeat(nb[at], s)
        u = np.repeat(alo[at], s) + within // width
        v = np.repeat(blo[at], s) + within % width
        near = (np.bitwise_count(key[u] ^ key[v]) <= max_bits) & (u != v)
        forest.link(u[near], v[near])


def block_bits(max_bits: int) -> int:
    """Bits of a block: at least ``max_bits`` + 1 blocks fit into 64 bits, so
    that two linked fingerprints agree on one of them."""
    if not 0 <= max_bits < 64:
        raise ValueError(f"max_bits must be 0 to 63, not {max_bits}")
    return min(BLOCK_BITS, 64 // (max_bits + 1))


def links(distinct: DataFrame, max_bits: int, n_tasks: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): a spanning forest, per cell, of all links between the distinct
    fingerprints ``fp``."""
    block = block_bits(max_bits)
    # a rotation by one block at a time; the front block names the cell
    rotated = distinct.select(
        "fp", F.posexplode(F.array([F.shiftleft("fp", block * j).bitwiseOR(F.shiftrightunsigned("fp", 64 - block * j)) if j
                                    else F.col("fp") for j in range(64 // block)])).alias("turn", "key"))
    rotated = rotated.withColumn("cell", (F.col("turn") * (1 << block) + F.shiftrightunsigned("key", 64 - block)).cast("long"))
    large = (rotated.groupBy("cell").count().where(F.col("count") > cell_rows)
             .select("cell", F.least(F.lit(16), F.ceil(F.log2(F.col("count") / cell_rows))).cast("int").alias("depth")))
    # cells over the limit: one task part per pair of deeper nodes in budget
    marked = rotated.join(large, "cell", "left")
    node = F.expr("shiftrightunsigned(shiftleft(key, %d), 64 - depth)" % block)
    other = F.expr(f"""case when depth is null then array(0L) else
        filter(transform(sequence(0L, shiftleft(1L, depth) - 1), m -> m), m -> bit_count(m) <= {max_bits}) end""")
    parts = (marked.withColumn("mask", F.explode(other))
             .withColumn("part", F.when(F.col("depth").isNull(), F.lit(0).cast("long"))
                         .otherwise(F.least(node, node.bitwiseXOR(F.col("mask"))) * F.lit(1 << 16).cast("long")
                                    + F.greatest(node, node.bitwiseXOR(F.col("mask"))) + 1))
             .select("cell", "part", "key", "turn")
             .withColumn("task", F.pmod(F.xxhash64("cell", "part"), F.lit(n_tasks)).cast("int")))

    def run(rows: pa.Table) -> pa.Table:
        cell = rows["cell"].to_numpy()
        part = rows["part"].to_numpy()
        key = rows["key"].to_numpy().view(np.uint64)
        order = np.lexsort((key, part, cell))
        cell, part, key, turn = cell[order], part[order], key[order], rows["turn"].to_numpy()[order]
        both = np.cumsum(np.concatenate(([0], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
        root = trie_links(both, key, max_bits, 64 - block)
        at = np.flatnonzero(root != np.arange(len(root)))
        back = (block * turn.astype(np.uint64))

        def unturn(k, t):
            right = np.where(t == 0, k, (k >> t) | (k << ((np.uint64(64) - t) & np.uint64(63))))
            return pa.array(right.view(np.int64))

        return pa.table({"u": unturn(key[at], back[at]), "v": unturn(key[root[at]], back[at])})

    return parts.groupBy("task").applyInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node with a link: alternating star rounds until
    nothing changes.  Only two counters per round come to the driver."""
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = now


def grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    n = distinct.count()
    roots = components(links(distinct.select("fp"), max_bits, max(1, 4 * n // TASK_ROWS + 1)))
    placed = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return grouped(docs, shingle, max_bits).drop("root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest
    id.  Rows of the component that repeat that id are put together into one;
    an id on rows of several components stands for each of them by itself;
    rows without an id cannot be named and stay."""
    own = (grouped(docs, shingle, max_bits).groupBy("doc_id", "root")
           .agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("component_id").alias("component_id")))
    own = cut_lineage(own.where("doc_id is not null"))
    rows = own.groupBy("doc_id").agg(F.sum("n").alias("n")).withColumnRenamed("doc_id", "_id")
    kept = cut_lineage(own.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id"), F.col("fp").alias("_kept_fp"))
                       .join(rows, F.col("_kept_id") == F.col("_id")).drop("_id"))
    same = F.col("doc_id").cast("long") == F.col("_kept_id")
    once = docs.join(kept.where("n = 1"), same, "left_semi")

    @F.arrow_udf("long")
    def print_of(text: pa.Array) -> pa.Array:
        data, offs = K.buffers(text)
        raw, o = data.tobytes(), offs.tolist()
        fp = np.fromiter((simhash(raw[a:b], shingle) for a, b in zip(o, o[1:])), dtype=np.uint64, count=len(o) - 1)
        return pa.array(fp.view(np.int64))

    # ids on several rows: the text tells which of them is kept
    several = kept.where("n > 1")
    often = (docs.join(several, same, "left_semi").withColumn("_fp", print_of(F.col("text").cast("string")))
             .join(several, same & (F.col("_fp") == F.col("_kept_fp")), "left_semi").dropDuplicates(["doc_id", "_fp"]).drop("_fp"))
    return once.unionByName(often).unionByName(docs.where(F.col("doc_id").isNull()))


@register("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return (near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
