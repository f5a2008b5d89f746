"""Sharding by extendible hashing, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Positional, Scratch, discard, materialize

LIMIT = 128 << 20
#: Bits of the hash; the directory never looks further.
BITS = 60


def hash_bits(*columns: Column) -> Column:
    """The first 60 bits of the md5 of the columns as text, as a non-negative long."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def split_directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Leaves (depth, prefix, bytes, documents) of the extendible directory over rows(h, bytes).

    Byte sums of the finest level in reach come from one map-side combined aggregate and
    are added up to all coarser levels in a second. A bucket is a leaf if it fits and its parent
    doesn't. Buckets too large at the finest level go on to step bits more, each time over
    their own rows alone, until all fit or hold a single hash value.
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    base = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    leaves, low, live, scratch = None, 0, rows, Scratch()
    while True:
        fine = live.groupBy(prefix(F.col("h"), base).alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("documents"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        depths = F.explode(F.sequence(F.lit(low), F.lit(base))).alias("depth")
        each = fine.select("*", depths).select("depth", F.expr(f"shiftright(prefix, {base} - depth)").alias("prefix"), "bytes", "documents", "lo", "hi")
        nodes = scratch(
            each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("documents").alias("documents"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .withColumn("fits", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
        )
        up = nodes.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        below = nodes.where("fits").withColumn("up", F.shiftright("prefix", 1)).join(up, ["depth", "up"], "left_semi")
        found = below.select("depth", "prefix", "bytes", "documents")
        if not low:  # the whole space may be one bucket
            found = found.union(nodes.where("fits and depth = 0").select("depth", "prefix", "bytes", "documents"))
        over = nodes.where((F.col("depth") == base) & ~F.col("fits"))
        leaves = found if leaves is None else leaves.union(found)
        if base >= BITS:  # nothing is left to split on
            leaves = leaves.union(over.select("depth", "prefix", "bytes", "documents"))
            break
        if over.isEmpty():
            break
        live = live.join(over.select(F.col("prefix").alias("up")), prefix(F.col("h"), base) == F.col("up"), "left_semi")
        low, base = base, min(BITS, base + step)
    out = materialize(leaves)
    scratch.clear()
    return out


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most_broadcast: int = 2_000_000) -> DataFrame:
    """docs with shard (string), shard_bytes and shard_documents.

    shard names the hash prefix as bits ('' is the whole space), and '+k' is appended to
    overflow pages. Bytes are the UTF-8 bytes of the text, 0 for null. Every shard fits
    limit bytes, except a shard that holds one document larger than that by itself. Rows
    whose ids are equal share a hash and can't be told apart by it: if together they pass
    the limit, they fill overflow pages of at most limit bytes, dealt in lanes so that no
    task sees more than about one page. Null ids hash as an empty text. An empty table
    gives an empty result. A column named like an added one is replaced; other columns may
    have any names. The directory is broadcast in parts of about most_broadcast leaves,
    each met by the documents of its prefixes, so texts are never shuffled.
    """
    own = Positional(docs)
    keyed = own.frame.select("*", hash_bits(F.col(own(id_col))).alias("h"), F.coalesce(F.octet_length(own(text_col)), F.lit(0)).cast("long").alias("bytes"))
    rows = materialize(keyed.select("h", "bytes"))
    leaves = split_directory(rows, limit)
    discard(rows)
    counts = {r["depth"]: r["n"] for r in leaves.groupBy("depth").agg(F.count("*").alias("n")).collect()} or {0: 0}
    key = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("h"), d).alias("prefix")) for d in sorted(counts)])).alias("key")
    side = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("documents").alias("shard_documents"))
    top = max(0, math.ceil(math.log2(max(1, sum(counts.values()) / most_broadcast))))  # bits that cut the directory into parts to broadcast
    placed = None
    for part in range(1 << top):
        wide = F.col("depth") < top
        mine = side.where(F.when(wide, F.expr(f"shiftright({part}L, {top} - depth)") == F.col("prefix")).otherwise(F.expr(f"shiftright(prefix, depth - {top})") == part))
        found = keyed.where(prefix(F.col("h"), top) == part) if top else keyed
        found = found.select("*", key).join(F.broadcast(mine), (F.col("key.depth") == F.col("depth")) & (F.col("key.prefix") == F.col("prefix")))
        placed = found if placed is None else placed.union(found)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    columns = [*own.names, "shard", "shard_bytes", "shard_documents"]
    placed = placed.withColumn("shard", bits)
    added = columns[-3:]
    crowded = (F.col("shard_bytes") > limit) & (F.col("shard_documents") > 1)
    if leaves.where("documents > 1").where(F.col("bytes") > limit).isEmpty():
        return own.back(placed, *added)
    lanes = F.ceil(F.col("shard_bytes") / F.lit(limit))
    # written once: sizes and rows must see the same numbers, whichever tasks are run again
    over = materialize(placed.where(crowded).select(*columns, "bytes", F.monotonically_increasing_id().alias("n"), lanes.alias("lanes")))
    over = over.withColumn("lane", F.pmod(F.xxhash64("n"), F.col("lanes")))
    lane = W.partitionBy("shard", "lane").orderBy("n")
    # a page closes before it overflows: pages of half-limit steps hold at most one step more than a half
    half = F.lit(max(1, limit // 2))
    before = F.sum("bytes").over(lane) - F.col("bytes")
    page = F.when(F.col("bytes") > half, F.concat_ws(".", F.col("lane").cast("string"), F.lit("x"), F.row_number().over(lane).cast("string"))).otherwise(
        F.concat_ws(".", F.col("lane").cast("string"), F.floor(before / half).cast("string"))
    )
    over = over.withColumn("shard", F.concat(F.col("shard"), F.lit("+"), page))
    sizes = over.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_documents"))
    over = over.drop("shard_bytes", "shard_documents").join(sizes, "shard")
    return own.back(placed.where(~crowded).select(*columns).union(over.select(*columns)), *added)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder a shard; rows of a shard meet in one task, which the limit bounds."""
    assign_shards(docs, **options).repartition("shard").write.partitionBy("shard").parquet(path)
