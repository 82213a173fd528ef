"""Jump consistent hashing: stable keys to shards without a ring table.

``jump_hash`` gives each 64-bit key a shard by drawing the next shard count at which the key would move, until that count
passes the number of shards. Going from n to n+1 shards moves 1/(n+1) of the keys, all of them into the new shard.

``assign_shards`` also numbers the rows of every shard without gaps. A shard holds a fixed share of all rows, so it is never
ordered in one task: rows are counted by (shard, bucket of the key), the counts of buckets become offsets, and only the rows of
a bucket are numbered together. Rows that are alike in all their columns are counted first and spread out again at the end, so
a key that holds a third of all rows is one row while it is numbered.

Defined cases: a null key is hashed as the text "null" (``assign_shards``) and gets shard and slot like any other; a null text
has size 1 and the checksum of no bytes; repeated rows get a slot each; an empty table gives an empty result; further columns of
the input are ignored, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.llm._shared import stage

#: Rows that are numbered together, about.
BUCKET_ROWS = 50_000
#: Slots of one array when alike rows are spread out again.
SPREAD = 65_536

# Fixed values of the published algorithm: the multiplier of its 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key, from 0 to shards - 1."""
    if shards < 1:
        raise ValueError("the number of shards must be positive")
    state = np.array(keys).astype(np.uint64, copy=True)
    settled = np.zeros(len(state), np.int64)
    open_rows, jump = np.arange(len(state)), np.zeros(len(state), np.int64)
    with np.errstate(over="ignore"):
        while len(open_rows):
            settled[open_rows] = jump
            s = state[open_rows] * np.uint64(MULTIPLIER) + np.uint64(1)
            state[open_rows] = s
            jump = ((settled[open_rows] + 1) * (2147483648.0 / ((s >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            inside = jump < shards
            open_rows, jump = open_rows[inside], jump[inside]
    return settled


def shard_of(key, shards: int):
    """Column: the shard of a key column, by its 64-bit hash as text."""

    @F.pandas_udf("int")
    def jump(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))))


def assign_shards(df: DataFrame, key: str, shards: int, carry: list[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (key, *carry, shard, slot, grown_shard): slots count from 0 within each shard without gaps, in an order that only the
    rows' values decide; grown_shard is the shard when one more is appended."""
    cols = [F.col(f"`{key}`").alias("k0"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))]
    alike = [f"c{i}" for i in range(len(carry))]
    rows = df.select(*cols).groupBy("k0", *alike).agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows.withColumn("shard", shard_of(F.col("k0"), shards)).withColumn("grown_shard", shard_of(F.col("k0"), shards + 1)), "shards")
    buckets = max(1, -(-rows.count() // (bucket_rows * shards)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("k0").cast("string"), F.lit("null")), F.lit("slot")), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("k0", *alike).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "bucket"])
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {SPREAD}"))).alias("part"))
    first = F.col("base") + F.col("ahead") + F.col("part") * SPREAD
    last = F.col("base") + F.col("ahead") + F.least(F.col("n"), (F.col("part") + 1) * SPREAD) - 1
    return placed.select(F.col("k0").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "shard", "grown_shard", F.explode(F.sequence(first, last)).alias("slot"))


def op5_sharding(spark, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents into shards by the law "key": doc_id and the number of shards decide."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = docs.select("doc_id", (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content).alias("text_crc32"))
    out = assign_shards(sized, "doc_id", shards, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
