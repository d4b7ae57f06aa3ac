"""A training-corpus pipeline: five stages, each written as Parquet and read back by the next.

``run(spark, sf_dir)`` applies them to the table ``documents``.  All stages but the last return
the columns of ``documents``; rows that a stage rejects are gone for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.bpe import encode_decode
from shelfcast.llm.common import prepare, store, table, text_bytes
from shelfcast.llm.exact_dedup import exact_duplicates, folded
from shelfcast.llm.mixing import mix
from shelfcast.llm.near_dedup import near_duplicates, text_key
from shelfcast.llm.toxicity import score_column, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the score reads the text alone.

    Null and empty texts score like one empty window.  Repeated rows and null ids are scored each for
    themselves; without labels of both classes every row stays.
    """
    prepare(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", score_column(model, text_bytes("text"))).where("__score < 0.5").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat id and text, one.

    A null text equals an empty one.  A null id stays only where no other id has the text, and then once.
    """
    def key(digest):
        return F.concat_ws(":", digest, F.col("doc_id").cast("string"))

    kept = exact_duplicates(docs, "largest").where("kept").select(key(F.col("text_sha256")).alias("__key")).distinct()
    rows = docs.withColumn("__key", key(F.sha2(folded("text").cast("binary"), 256)))
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    Where an id carries several texts, only those that are near copies go.  Texts without words and
    rows of a null id stay; rows that repeat id and text stay or go together.
    """
    dropped = near_duplicates(docs, keyed=True).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(dropped, (F.col("doc_id") == F.col("__id")) & (text_key("text") == F.col("__key")), "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as the mix takes it, perhaps never.

    Rows of one id (there is one, unless an id carries several texts) are taken equally often, those
    of the null id too.  Null and blank texts have no words to take: they stand as often as whole passes
    over their source, and once more where they come before the end of the last part.  A null source
    is a source of its own.
    """
    passes = mix(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).groupBy("doc_id").agg(F.max("passes").alias("__passes"))
    rows = docs.join(passes.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__passes")))).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, with their number and digests.

    One row per input row, repeated rows and null ids included; null and empty texts have no ids.
    """
    return encode_decode(docs, with_ids=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The stages that learn a classifier and join similar sets have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
