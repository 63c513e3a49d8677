"""Shard assignment by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import columns_named, written

#: Multiplier of the generator in the published algorithm. Fixed value.
JUMP_MULTIPLIER = 2862933555777941757
#: Rows that one task numbers on average.
BUCKET_ROWS = 200_000


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards for 64-bit keys, all lanes stepped together; a lane leaves once it jumps past the end.

    The expected number of steps is ln(n_shards), with no table of ring points.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    lanes = np.arange(len(state))
    position = np.zeros(len(state), dtype=np.int64)
    while len(lanes):
        shard[lanes] = position
        state = state * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        scale = float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0)
        position = ((position + 1) * scale).astype(np.int64)
        stays = position < n_shards
        lanes, state, position = lanes[stays], state[stays], position[stays]
    return shard


def shards_of(key: Column, n_shards: int) -> Column:
    """The shard of a stable key, and with one shard more: (shard, grown). Keys of any type are hashed to 64 bits first; null is a key too."""

    @F.pandas_udf("shard int, grown int")
    def assign(hashed: pd.Series) -> pd.DataFrame:
        keys = hashed.to_numpy()
        return pd.DataFrame({"shard": jump_hash(keys, n_shards).astype(np.int32), "grown": jump_hash(keys, n_shards + 1).astype(np.int32)})

    return assign(F.xxhash64(key))


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (with one shard more).

    Only the key and the shard count decide, so repeated rows share a shard; growing by one moves
    about 1/(n+1) of the keys, all into the new shard. A null key is one key. Nothing is shuffled.
    Columns with these two names are replaced; others pass through.
    """
    others = [c for c in docs.columns if c not in ("shard", "grown_shard")]
    both = docs.select(F.struct(*columns_named(others)).alias("row"), shards_of(columns_named([key])[0], n_shards).alias("both"))
    return both.select("row.*", F.col("both.shard").alias("shard"), F.col("both.grown").alias("grown_shard"))


def number_slots(rows: DataFrame, key: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each shard, without gathering a shard in one task.

    Rows are dealt to buckets by a hash of ``key`` and numbered by it within (shard, bucket). There are
    so many buckets that one holds ``bucket_rows`` rows on average. The counts of the buckets give
    each its first number; they are joined by the same two columns, which moves only the counts.
    Ties are rows that are equal in ``key``; they are told apart by their number in storage, so that however many
    there are they fall into all buckets. ``rows`` must be stored, for it is read three times.
    """
    buckets = max(64, -(-rows.count() // bucket_rows))
    where = rows.metadataColumn("_metadata")
    place = [where["file_path"], where["row_index"]]
    bucketed = rows.select("*", F.pmod(F.xxhash64(*key, *place), F.lit(buckets)).cast("int").alias("_bucket"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*key)
    numbered = bucketed.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_bucket", "_start", "_at")


def shard_documents(docs: DataFrame, n_shards: int = 8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every document with its shard, its slot there and its shard after growth by one.

    Null text has size 1 (no bytes, plus 1) and the checksum of no bytes. Null doc_ids share a shard,
    but not a bucket. Repeated rows get a slot each. A very long text is measured in place and not
    moved. An empty table gives no rows. Columns other than doc_id and text, whatever their names, are
    not read. The documents are scanned once; what is written to the shared folder and shuffled are six numbers a row.
    """
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    placed = number_slots(written(assign_shards(sized, n_shards), "shards"), ["doc_id", "text_crc32", "size"], bucket_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
