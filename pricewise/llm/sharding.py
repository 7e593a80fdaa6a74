"""Sharding along a Hilbert curve.

Several metadata dimensions of a document (source, language, size) are
quantised to a few bits each, the cell they name gets its index on a Hilbert
curve, and the table is put in curve order.  Cutting that order into runs
gives shards whose files cover small boxes of the metadata space, so a filter
on any of the dimensions prunes files.

Only DataFrame functions are used.  The global order comes from a range
partitioning on (curve index, text hash, id); a row's rank is its place in its
partition plus the rows of the partitions before.  One table entry per
partition is all that is ever gathered.  Copies of one text are neighbours in
the order, and a hot cell or text is split over partitions by id.

The law is ``rows``: shard counts are at most one apart.

Results in special cases: null source or language is quantised as an empty
string and a null text as an empty one (size 16, CRC 0); equal rows get
different slots; with fewer rows than shards some shards stay empty; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.registry import free_name, register, table
from pricewise.session import cut_lineage

SHARDS = 40
ROW_BYTES = 16  # added to each text's size
BITS = 8        # per dimension


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state of the n-dimensional Hilbert curve for every
    (state, cell), from the Gray-code rule: a state is an entry corner and a
    main direction, 2^n * n of them."""
    size, mask = 1 << n, (1 << n) - 1

    def rotate(x, k):
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}

    def entry(w):
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def turn(w):
        if w == 0:
            return 0
        trailing = w - 1 if w % 2 == 0 else w
        ones = 0
        while trailing & 1:
            ones, trailing = ones + 1, trailing >> 1
        return ones % n

    digit, follow = [], []
    for state in range(size * n):
        e, d = divmod(state, n)
        for cell in range(size):
            w = rank[rotate(cell ^ e, n - (d + 1) % n)]
            digit.append(w)
            follow.append((e ^ rotate(entry(w), d + 1)) * n + (d + turn(w) + 1) % n)
    return digit, follow


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates (each in
    0..2^bits - 1)."""
    n = len(dims)
    digit, follow = (F.array(*map(F.lit, t)) for t in curve_table(n))

    def step(acc, b):
        cell = sum((F.call_function("shiftright", d, b).bitwiseAND(F.lit(1)) * (1 << i)
                    for i, d in enumerate(dims)), F.lit(0))
        at = acc["state"] * (1 << n) + cell + 1
        return F.struct((acc["index"] * (1 << n) + F.element_at(digit, at)).cast("long").alias("index"),
                        F.element_at(follow, at).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def shard(docs: DataFrame, n_shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve (index), law, shard, slot; with
    ``carry`` also ``document``, the row itself."""
    own = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document")] if carry else []
    kept = ["document"] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *own)
    top = (1 << BITS) - 1

    def bucket(c):
        return F.pmod(F.xxhash64(c), F.lit(top + 1)).cast("int")

    large = F.least(F.lit(top), F.floor(F.log2("size") * 12)).cast("int")
    rows = rows.withColumns({"x": bucket("source"), "y": bucket("lang"), "z": large})
    order = ["curve", "text_crc32", "text_hash", "doc_id", "at"]
    placed = (rows.withColumn("curve", hilbert_index([F.col("x"), F.col("y"), F.col("z")]))
              .withColumn("at", F.monotonically_increasing_id())  # parts equal rows too
              .select("doc_id", "size", "text_crc32", "text_hash", "curve", "at", *kept)
              .repartitionByRange(*order).sortWithinPartitions(*order))
    # partition number in the upper bits, place in the partition in the lower 33
    placed = cut_lineage(placed.select("doc_id", "size", "text_crc32", "curve",
                                       F.monotonically_increasing_id().alias("at"), *kept))
    # one row per partition of the range partitioning: as many as shuffle partitions
    totals = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    n = max(1, placed.count())
    rank = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
            .withColumn("rank", rank)
            .withColumn("shard", F.expr(f"int(rank * {n_shards} div {n}L)"))
            .select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard",
                    F.expr(f"rank - (shard * {n}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"), *kept))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Write whole documents, one folder per shard, in curve order; every row
    once, also those that share an id or have none."""
    placed = shard(docs, n_shards, carry=True).select("document", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    own = free_name(docs.columns, "shard")  # the folders' column
    (placed.repartition(n_shards, "_shard").sortWithinPartitions("_shard", "_slot")
     .select("document.*", F.col("_shard").alias(own)).write.partitionBy(own).parquet(path))


@register("op10_hilbert_sharding")
def op10(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
