"""Balanced, shuffled shards by a two-pass external shuffle; native functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.session import materialise

#: Rows of the bucket table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def shard(docs: DataFrame, doc_id: str, text: str, shards: int = 8, seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard; columns of those names give way.

    First pass: seeded hashes of id and text scatter the rows uniformly into buckets of about
    ``bucket_bytes`` of text, whatever source or group of equal texts they come from.
    Second pass: each bucket, in the order of a second hash, is shuffled by Spark's ``shuffle``
    (Fisher-Yates) and written. The buckets stand one after another; row g of all goes to
    slot g div shards of shard g mod shards, so that row counts are at most one apart
    (law ``rows``) and slots have no gaps. ``grown_shard`` belongs to another law: null.

    Null texts have size 1 and crc32 0. Rows that repeat id and text share a bucket; if they
    exceed it, they are dealt in turn to as many buckets as they fill.
    An empty table gives an empty one. The written buckets fix the order: what is read
    after an executor is lost is the same.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    names = [c for c in docs.columns if c.lower() not in made]
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    size, crc = (F.octet_length(body) + 1).cast("bigint"), F.crc32(body)
    # The row travels as one value, so no column of it can clash with those made here.
    plain = docs.select(
        F.col(f"`{doc_id}`").alias("id"), crc.alias("crc"), size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    )
    totals = plain.agg(F.sum("size").alias("bytes")).first()
    buckets = max(1, math.ceil((totals["bytes"] or 0) / bucket_bytes))
    key = ["id", "crc", "size"]
    home = F.xxhash64(F.lit(seed), *key)
    # Keys whose rows exceed a bucket: one at most for every bucket_bytes of text.
    crowded = plain.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    crowded = materialise(
        crowded.where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select(
            home.alias("home"), F.ceil(F.col("bytes") / bucket_bytes).alias("spread")
        ).groupBy("home").agg(F.max("spread").alias("spread")), "crowded-keys",
    )
    turn = F.lit(0)
    if not crowded.isEmpty():
        # Written before the exchange: the running number of a row depends on where it is read.
        numbered = plain.select("*", home.alias("home"), F.monotonically_increasing_id().alias("at"))
        numbered = numbered.join(F.broadcast(crowded) if buckets <= BROADCAST_ROWS else crowded, "home", "left")
        plain = materialise(numbered.select(*key, "row", F.coalesce(F.pmod("at", "spread"), F.lit(0)).alias("turn")), "numbered")
        turn = F.col("turn")
    scattered = plain.select(
        F.pmod(F.pmod(home, F.lit(buckets)) + turn, F.lit(buckets)).cast("int").alias("bucket"),
        F.struct(F.xxhash64(F.lit(seed + 1), *key).alias("order"), "size", F.col("crc").alias("text_crc32"), "row").alias("record"),
    )
    # The seeded order comes first, so that a bucket is shuffled from the same start on any run.
    dealt = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    dealt = materialise(dealt.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "record")), "buckets")
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    counts = materialise(counts, "bucket-sizes")
    # One row per bucket: the running sum reads a few bytes for every bucket_bytes of text.
    offsets = counts.selectExpr("bucket", "sum(n) over (order by bucket rows between unbounded preceding and 1 preceding) as before")
    placed = dealt.join(F.broadcast(offsets) if buckets <= BROADCAST_ROWS else offsets, "bucket")
    g = F.coalesce("before", F.lit(0)) + F.col("place")
    return placed.select(
        *[F.col(f"record.row.`{c}`") for c in names],
        F.col("record.size").alias("size"),
        F.col("record.text_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (g % shards).cast("int").alias("shard"),
        ((g - g % shards) / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
