"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable integer key walks the published jump sequence
``b <- j; key <- key * 2862933555777941757 + 1 (mod 2^64);
j <- floor((b + 1) * 2^31 / ((key >> 33) + 1))`` until ``j`` passes the number of
shards; ``b`` is the shard. There is no ring table, the assignment of a key
depends on nothing but the key and the number of shards, and one more shard
takes its ``1/(n+1)`` of the keys and moves no key between the old ones.

The 64-bit product is exact in ``decimal(38,0)`` (below 5.4e37), so no setting
for integer overflow matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxwise.llm.common import text_or_empty, utf8, written

# Fixed values of the published jump hash.
MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
TWO_33 = "8589934592"


def jump_hash(key: Column, *shards: int) -> Column:
    """Struct with one int field ``n<count>`` per number of shards, all from one
    walk. ``key`` is a 64-bit integer, a null key is taken as 0. The walk has at
    most ``max(shards)`` steps, as ``j`` grows in each of them."""
    if not shards or min(shards) < 1:
        raise ValueError("the number of shards must be at least 1")
    most = max(shards)
    k = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    start = F.struct(
        F.when(k < 0, k + F.expr(f"{TWO_64}BD")).otherwise(k).cast("decimal(20,0)").alias("key"),
        F.lit(0).cast("bigint").alias("j"),
        *[F.lit(0).cast("bigint").alias(f"n{n}") for n in shards])

    def step(s: Column, _: Column) -> Column:
        key2 = ((s["key"] * F.expr(f"{MULTIPLIER}BD") + F.lit(1).cast("decimal(1,0)"))
                % F.expr(f"{TWO_64}BD")).cast("decimal(20,0)")
        # the new key is needed twice: bind it once through a one-element array
        new = F.transform(F.array(key2), lambda x: F.struct(
            x.alias("key"),
            F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (
                ((x - x % F.expr(f"{TWO_33}BD")) / F.expr(f"{TWO_33}BD")).cast("double") + F.lit(1.0)))
            ).cast("bigint").alias("j"),
            *[F.when(s["j"] < n, s["j"]).otherwise(s[f"n{n}"]).alias(f"n{n}") for n in shards]))[0]
        return F.when(s["j"] < most, new).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return F.struct(*[walked[f"n{n}"].cast("int").alias(f"n{n}") for n in shards])


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` numbers the rows of a shard without gaps from 0 in the order of
    doc_id (nulls first; repeated ids in the order of their size, checksum and
    place). A null text has size 8 and the checksum of the empty text; an empty
    table gives no rows; other columns are not read.

    Only (id, size, checksum, shard) rows move: they are dealt out by range over
    the id, their place within (range, shard) is a bounded window, and the start
    of each (range, shard) comes from one count per pair. A hot id is split by
    the row's place, so no task holds a whole shard.
    """
    text = text_or_empty(text_col)
    narrow = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 8).alias("size"),
            F.crc32(utf8(text)).alias("text_crc32"),
            jump_hash(F.col(id_col), shards, shards + 1).alias("jump"))
        .select("doc_id", "size", "text_crc32", F.col(f"jump.n{shards}").alias("shard"),
                F.col(f"jump.n{shards + 1}").alias("grown_shard"),
                F.monotonically_increasing_id().alias("place")), "shards")
    keys = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("place")]
    ranged = written(narrow.repartitionByRange(*keys).select(
        "*", F.spark_partition_id().alias("part")), "shards-ranged")
    from pyspark.sql import Window as W
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "part", (
        F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("start"))
    inside = ranged.withColumn("at", F.row_number().over(W.partitionBy("part", "shard").orderBy(*keys)))
    return inside.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.coalesce("start", F.lit(0)) + F.col("at") - 1).cast("bigint").alias("slot"), "grown_shard")
