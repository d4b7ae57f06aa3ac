"""Exact de-duplication by a tree merge of sorted digest runs."""

from __future__ import annotations

import functools
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import prepare, store, table

#: Runs merged into one in a round.
FAN_IN = 16
#: What makes two texts equal: digest, and as verification an independent hash and the length.
KEY = ["digest", "check", "bytes"]


def folded(text: str = "text"):
    """The text with A-Z (only) in lower case, null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def merge_run(keep: str):
    """Merge a stream that is sorted by ``KEY`` (inside run and slice): one entry per equal key.

    The entry of the last key is held back until the next batch shows that the key has ended, so
    a key of any number of entries is merged in constant memory.
    """
    by = ["run", "slice", *KEY]
    pick = "min" if keep == "smallest" else "max"

    def merge(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            merged = rows.group_by(by, use_threads=False).aggregate([("keep_id", pick), ("n", "sum")])
            merged = merged.rename_columns([*by, "keep_id", "n"]).select(rows.column_names).cast(rows.schema)
            last = functools.reduce(pc.and_, (pc.equal(merged[c], rows[c][-1]) for c in by))  # groups come in any order
            held = merged.filter(last)
            yield from merged.filter(pc.invert(last)).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return merge


def exact_duplicates(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Each input partition is a sorted run with one entry per distinct text.  In every round the runs
    of ``FAN_IN`` neighbours are exchanged and merged, while the digest range is cut into
    ``FAN_IN`` times as many slices, so that no round, not even the last, passes a run through one
    task.  Each level keeps the smallest or largest id of a key and its number of rows; a text
    that fills a third of the corpus is one entry per run.  Entries are equal only if SHA-256, an
    independent 64-bit hash and the length agree.  One round is always made, as the part of a run
    that a large file's split begins is merged apart; after the last, a key stands once.

    A null text is empty; a null id is never kept before another id, and a group of null ids only
    keeps all its rows.  Rows that repeat id and text are all marked alike.
    """
    prepare(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), folded(text_col).alias("__text"))
    rows = store(text.select(
        "doc_id", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("digest"), F.xxhash64("__text").alias("check"),
        F.octet_length("__text").cast("long").alias("bytes"), F.spark_partition_id().alias("run")))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    schema = "run int, slice int, digest binary, check bigint, bytes bigint, keep_id bigint, n bigint"
    merge = merge_run(keep)
    entries = rows.select("run", F.lit(0).alias("slice"), *KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    level = entries.sortWithinPartitions("run", *KEY).mapInArrow(merge, schema)
    prefix, slices = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 1
    while True:
        runs, slices = -(-runs // FAN_IN), slices * FAN_IN
        level = (level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
                 .withColumn("slice", F.floor(prefix * F.lit(slices) / F.lit(1 << 32)).cast("int"))
                 .repartition("run", "slice").sortWithinPartitions("run", "slice", *KEY)
                 .mapInArrow(merge, schema))
        if runs == 1:
            break
    winners = level.select(*KEY, "keep_id", F.col("n").alias("group_size"))
    return rows.join(winners.hint("merge"), KEY).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
