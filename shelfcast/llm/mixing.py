"""Mixing sources to target weights: Efraimidis-Spirakis order inside each source, prefix sums to a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import blocked_prefix, prepare, store, table

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
#: Blocks of the key's range; no task sorts more than one block of one source.
BLOCKS = 1024
#: Quality weights of a document: labelled good, not labelled, labelled bad.
QUALITY = (2.0, 1.0, 0.5)
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(src, source_size) -> (src, source_size, target).

    Sources in code-point order, null last, take ``weights`` in turn.  A target never exceeds
    ``max_epochs`` times its source; the excess is shared again by weight.  The fixed point is
    reached in one step: sorted by the level at which they fill up, the sources that fill are a
    prefix, and the first source that does not fill gives the level of all that follow.  One row
    per source is handled here, not one per document.
    """
    ranked = sizes.withColumn("__at", F.row_number().over(Window.orderBy(F.col("src").isNull(), "src")) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("__at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", w).withColumn("__cap", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.least(total_share * F.sum("source_size").over(all_rows), F.sum("__cap").over(all_rows))
    level = ranked.withColumn("__level", (budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
    open_level = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level").alias("l")))).over(all_rows)
    return level.select("src", "source_size", F.least(F.col("__cap"), F.coalesce(open_level["l"] * F.col("__w"), F.col("__cap"))).alias("target"))


def uniform(id_col):
    """A number in (0, 1) that only the id decides: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, quality: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
        max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, passes, taken.

    ``quality`` holds (doc_id, quality); a document's weight is that of ``QUALITY``.  Its key is
    -ln(u) / weight, and the documents of a source stand in the order of their keys.  A source
    whose target is above its size is first taken whole, ``floor(target / size)`` times; what is
    left of the target goes to the documents in key order as long as half of a document still
    fits, so that the taken words end within half a document of the target.

    A null or blank text has size 0 and takes nothing; a null source is a source of its own, last
    in order; a null id hashes like an empty one; repeated rows count each for themselves.
    """
    prepare(docs.sparkSession)
    good, plain, bad = QUALITY
    marks = quality.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__q"))
    rows = docs.select("doc_id", F.col("source").alias("src"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    weight = F.when(F.col("__q") == 1, good).when(F.col("__q") == 0, bad).otherwise(plain)
    rows = rows.join(marks, "doc_id", "left").withColumn("__key", -F.log(uniform(F.col("doc_id"))) / weight)
    # a monotone map of the key to blocks that are about equally full
    rows = store(rows.withColumn("__block", F.floor((1 - F.exp(-F.col("__key"))) * BLOCKS).cast("int"))
                 .select("doc_id", "src", F.when(F.col("src").isNull(), "n").otherwise(F.concat(F.lit("s"), "src")).alias("__source"), "size", "__key", "__block"))
    totals = rows.groupBy("src", "__source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals.select("src", "source_size"), weights, total_share, max_epochs)
    targets = store(targets.withColumn("__source", F.when(F.col("src").isNull(), "n").otherwise(F.concat(F.lit("s"), "src"))).drop("src"))
    placed = blocked_prefix(rows, ["__source"], "__block", ["__key", "doc_id", "size"], F.col("size"), "__before")
    placed = placed.join(targets, "__source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("__epochs", epochs).withColumn("__left", F.col("target") - F.col("__epochs") * F.col("source_size"))
    chosen = (F.col("__before") + F.col("size") / 2.0 <= F.col("__left")) & (F.col("__left") > 0)
    placed = placed.withColumn("passes", (F.col("__epochs") + F.when(chosen, 1).otherwise(0)).cast("int"))
    return placed.select("doc_id", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


OP6_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS k
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
f AS (SELECT arg_min(lvl, cap / w) AS lvl FROM l WHERE lvl <= cap / w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM f) * w, cap)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END)::INTEGER AS passes FROM p)
SELECT doc_id, size, source_size, target, passes, (passes * size)::BIGINT AS taken FROM r
"""
