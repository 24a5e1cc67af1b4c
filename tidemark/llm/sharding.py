"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash (Lamping and Veach, 2014) walks a 64-bit linear congruential generator seeded with the key; the shard is
the last jump below the shard count, so one more shard takes keys only into itself.  There is no ring or table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published generator: multiplier 2862933555777941757 and increment 1, modulo 2^64.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One generator step on 32-bit halves; no intermediate passes 2^50, so ANSI arithmetic never overflows."""
    m0, m1, m2, m3 = (MULTIPLIER >> s & 0xFFFF for s in (0, 16, 32, 48))
    t0, t1 = lo * F.lit(m0), lo * F.lit(m1)
    s = t0.bitwiseAND(F.lit(LOW)) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    up = F.shiftright(t0, 32) + F.shiftright(t1, 16) + F.shiftright(s, 32)
    for a, m_low, m_high in ((lo, m2, m3), (hi, m0, m1)):
        up = up + (a * F.lit(m_low)).bitwiseAND(F.lit(LOW)) + F.shiftleft((a * F.lit(m_high)).bitwiseAND(F.lit(0xFFFF)), 16)
    return up.bitwiseAND(F.lit(LOW)), s.bitwiseAND(F.lit(LOW))


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard (int, from 0) of a long key.  A null key is null."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    long = lambda x: F.lit(x).cast("long")

    def jump(acc: Column, _: Column) -> Column:
        hi, lo = _step(acc["hi"], acc["lo"])
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        on = acc["j"] < n_shards
        return F.struct(F.when(on, hi).otherwise(acc["hi"]).alias("hi"), F.when(on, lo).otherwise(acc["lo"]).alias("lo"), F.when(on, acc["j"]).otherwise(acc["b"]).alias("b"), F.when(on, F.least(j, long(n_shards))).otherwise(acc["j"]).alias("j"))

    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), long(-1).alias("b"), long(0).alias("j"))
    # j rises by one at least in each step, so n + 1 steps end the walk for every key
    return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards)), start, jump, lambda acc: acc["b"].cast("int"))


def shard(docs: DataFrame, key: str, n_shards: int, tie: list[Column] | None = None, lanes: int = 256) -> DataFrame:
    """Rows of ``docs`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in its shard).

    The key, of any type, is hashed to 64 bits first.  Null keys share one shard; repeated rows get a slot each; an
    empty table gives an empty result.  Slots need no task per shard: each shard is numbered in ``lanes`` lanes, drawn
    by a hash of the key and ``tie``, and lane offsets come from a table of n_shards * lanes counts, which bounds what
    is broadcast.
    """
    tie = tie or []
    number = F.xxhash64(F.col(key))
    out = docs.withColumns({"shard": jump_shard(number, n_shards), "grown_shard": jump_shard(number, n_shards + 1), "__lane": F.pmod(F.xxhash64(F.lit(7), F.col(key), *tie), F.lit(lanes)).cast("int")})
    counts = out.groupBy("shard", "__lane").agg(F.count("*").alias("__n"))
    first = F.sum("__n").over(Window.partitionBy("shard").orderBy("__lane")) - F.col("__n")
    offsets = counts.select("shard", "__lane", first.alias("__first"))
    slot = F.row_number().over(Window.partitionBy("shard", "__lane").orderBy(F.col(key), *tie)) - 1
    return out.withColumn("__slot", slot).join(F.broadcast(offsets), ["shard", "__lane"]).withColumn("slot", F.col("__slot") + F.col("__first")).drop("__lane", "__slot", "__first")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Shards of documents by doc_id (law ``key``).  A null text has size 1 and the checksum 0 of an empty text."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"))
    out = shard(narrow, "doc_id", n_shards, [F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
