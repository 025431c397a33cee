"""Sharding by extendible hashing: the directory doubles only where a bucket is over its byte limit. Native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60  # of the hash: the first 15 hex digits of an md5, so that SQL engines agree on it


def key_hash(key: Column) -> Column:
    """60-bit hash of a key; null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: str, size: Column, limit: int, round_bits: int = 12) -> DataFrame:
    """Key, size and shard of each row: (key, n_bytes, depth, shard_id, shard_bytes, oversized).

    A bucket is a prefix of the key's hash; one whose bytes are over `limit` splits on the next bit, so a row's depth is the
    first at which its bucket fits. shard_id is the prefix with a leading 1 bit. A bucket that holds a single hash value (one key,
    however often repeated) can't split: it stays and is marked oversized when over the limit. Null sizes count as 0, null keys
    as the empty key; repeated rows are rows of one key; very long texts make one large row; other columns, whatever their names, are
    ignored; an empty table gives an empty result. Each round settles `round_bits` levels from one histogram of
    prefixes, whose rows are bounded by 2**round_bits times the buckets that are still too large.
    """
    rows = stored(df.select(F.col(f"`{key}`").alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col(f"`{key}`")).alias("h")))
    done, low = [], 0
    while True:
        high = min(BITS, low + round_bits)
        cell = F.shiftright("h", BITS - high)
        cells = rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = cells.select("cell", "b", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fit = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
        placed = levels.select("cell", "depth", "prefix").join(fit.select("depth", "prefix", "shard_bytes"), ["depth", "prefix"])
        placed = placed.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
        found = rows.withColumn("cell", cell).join(placed, "cell", "left")
        done.append(found.filter("s is not null").select("key", "n_bytes", F.col("s.depth").alias("depth"), F.expr("shiftleft(1L, s.depth) + s.prefix").alias("shard_id"), F.col("s.shard_bytes").alias("shard_bytes")))
        rest = found.filter("s is null").select("key", "n_bytes", "h")
        if high == BITS or rest.isEmpty():
            break
        rows, low = stored(rest), high + 1  # the tables before stay, as their placed rows are still to be read
    out = reduce(DataFrame.unionByName, done)
    return out.withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(df: DataFrame, key: str, size: Column, limit: int, path: str) -> DataFrame:
    """Writes the rows below path/shard_id=.../ and returns the directory: one row per shard with depth, rows and bytes.

    A column of df named shard_id is replaced by the shard's. Rows with a null key are those of the empty key. A shard over the limit,
    whose rows share one key, is written by as many tasks as it has limits of bytes. An empty table writes no shard.
    """
    shards = assign_shards(df, key, size, limit)
    named = shards.groupBy(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("__key")).agg(F.first("shard_id").alias("__shard"), F.first("shard_bytes").alias("__bytes"))
    names = [c for c in df.columns if c != "shard_id"]
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    told = ["__key", *[f"__row.`{c}`" for c in names if not any(x in df.schema[c].dataType.simpleString() for x in ("map<", "variant"))]]  # Spark hashes no maps
    tasks = F.greatest(F.lit(1), F.ceil(F.col("__bytes") / limit))
    dealt = rows.join(named, "__key").withColumn("__task", F.pmod(F.xxhash64(*told), tasks)).repartition("__shard", "__task")
    out = dealt.select(*[F.col(f"__row.`{c}`").alias(c) for c in names], F.col("__shard").alias("shard_id"))
    out.write.partitionBy("shard_id").parquet(path)
    return shards.groupBy("shard_id", "depth", "shard_bytes", "oversized").agg(F.count("*").alias("n_rows"))
