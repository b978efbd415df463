"""Sharding by jump consistent hashing, in DataFrame functions only.

The shard depends on the key and the number of shards alone; going from n to
n + 1 shards moves 1/(n + 1) of the keys, all of them into the new shard.
``slot`` numbers each shard's rows 0, 1, 2, ... without gathering a shard in
one task: rows equal in every carried column are counted first (a hot key or
a third of identical rows becomes one counted row), each shard is cut into
ranges of about ``RANGE_ROWS`` counted rows by a uniform hash, ranges are
numbered on their own and shifted by the sizes of the ranges before them.

Defined results: a null key hashes as the empty string, so null and "" share
a shard; repeated rows get consecutive slots; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 5_000
COPY_CHUNK = 100_000

#: Multiplier of the jump hash's linear congruential generator, modulo 2^64.
JUMP_MULTIPLIER = 2862933555777941757
_LOW32 = 0xFFFFFFFF


def _hex32(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def key_digest(key: Column) -> Column:
    """MD5 of the key written as text: digits 1-16 seed the jumps, 17-32 order the rows of a shard."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of key * JUMP_MULTIPLIER + 1 modulo 2^64, in 32-bit halves so that nothing overflows."""
    m_hi, m_lo = JUMP_MULTIPLIER >> 32, JUMP_MULTIPLIER & _LOW32
    m0, m1 = m_lo & 0xFFFF, m_lo >> 16
    cross = lo * m1
    low = lo * m0 + F.shiftleft(cross.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(cross, 16)
    top = (lo * m_hi).bitwiseAND(F.lit(_LOW32)) + (hi * m0).bitwiseAND(F.lit(_LOW32)) \
        + F.shiftleft((hi * m1).bitwiseAND(F.lit(0xFFFF)), 16) + carry
    return top.bitwiseAND(F.lit(_LOW32)), low.bitwiseAND(F.lit(_LOW32))


def jump_shard(digest: Column, shards: int) -> Column:
    """Jump consistent hash of the digest's first 64 bits into ``shards`` buckets (int)."""
    zero = F.lit(0).cast("long")
    start = F.struct(_hex32(digest, 1).alias("hi"), _hex32(digest, 9).alias("lo"),
                     F.lit(-1).cast("long").alias("b"), zero.alias("j"))

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        reach = (s["j"] + 1).cast("double") * (F.lit(2.0 ** 31) / (F.shiftright(hi, 1) + 1).cast("double"))
        nxt = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), F.floor(reach).alias("j"))
        return F.when(s["j"] < shards, nxt).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["b"].cast("int"))


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Add the shard of ``key``; a map without shuffle."""
    return df.withColumn(name, jump_shard(key_digest(F.col(key)), shards))


def number_slots(df: DataFrame, key: str, shard: str, slot: str = "slot") -> DataFrame:
    """Add gapless slots per shard, in the order of (key digest, all other columns).

    ``df`` should be narrow (ids, sizes, checksums): its rows are shuffled.
    """
    carried = df.columns
    order = F.substring(key_digest(F.col(key)), 17, 16)
    counted = df.groupBy(*carried).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_order", order)
    rows = df.select(key).count()
    n_shards = df.select(shard).distinct().count() or 1
    ranges = max(1, math.ceil(rows / (n_shards * RANGE_ROWS)))
    part = F.shiftright(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * ranges, 32)
    counted = counted.withColumn("_range", part)
    within = Window.partitionBy(shard, "_range").orderBy("_order", *[F.col(c).asc_nulls_first() for c in carried])
    numbered = counted.withColumn("_at", F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = counted.groupBy(shard, "_range").agg(F.sum("_copies").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(shard).alias("_shard"), F.col("_range").alias("_r"),
                         F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(sizes, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_range") == F.col("_r")))
    first = F.col("_before") + F.coalesce(F.col("_at"), F.lit(0))
    chunks = joined.select(*carried, first.alias("_first"), "_copies",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1,
                                                F.lit(COPY_CHUNK).cast("long"))).alias("_chunk"))
    last = F.least(F.col("_chunk") + COPY_CHUNK, F.col("_copies")) - 1
    return chunks.select(*carried, "_first", F.explode(F.sequence(F.col("_chunk"), last)).alias("_copy")) \
        .select(*carried, (F.col("_first") + F.col("_copy")).alias(slot))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_shard(key_digest(F.col(id_col)), shards).alias("shard"),
        jump_shard(key_digest(F.col(id_col)), shards + 1).alias("grown_shard"))
    return number_slots(narrow, id_col, "shard").select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard (``shard=k``), several files per shard when large."""
    with_shard(docs, id_col, shards).write.partitionBy("shard").parquet(path)
