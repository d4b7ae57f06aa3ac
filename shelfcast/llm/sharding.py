"""Jump consistent hashing: stable keys to shards, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blocked_prefix, prepare, store, table

N_SHARDS = 40
#: Blocks into which the rows of a shard are dealt for slot numbers; a shard's rows never meet in one task.
BLOCKS = 1024


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard 0..n-1 of each 64-bit key; with one more shard a key stays or moves into the new one."""
    key = np.array(keys, np.uint64)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = 2.0 ** 31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[jump[live] < n]
    return shard


def jump_column(key, n: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), n), dtype="int32")

    return shard(key)


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: shard by the law ``key``, with a gapless slot inside the shard.

    The key is the id, scrambled to 64 bits, so only id and shard count decide.  A null id is a key
    of its own; a null text counts as empty (its checksum is 0).  Repeated rows share a shard and
    take a slot each.  Slots follow (block of the key, id, checksum, size), so reruns agree up to
    rows that are equal in all of them.  Columns other than id and text are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"),
                       F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
                       F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = store(rows.select(
        "doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", jump_column(F.col("key"), n_shards).alias("shard"),
        jump_column(F.col("key"), n_shards + 1).alias("grown_shard"), F.pmod("key", F.lit(BLOCKS)).alias("block")))
    placed = blocked_prefix(rows, ["shard"], "block", ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
