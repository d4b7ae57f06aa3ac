"""The corpus pipeline, stage by stage, on small whole tables."""

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as E
from shelfcast.llm import near_dedup
from shelfcast.llm.common import store, table
from tests.conftest import SF001
from tests.llm.test_operators import fold, near_brute


def test_queries_are_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages(spark):
    docs = table(spark, SF001, "documents")
    docs = store(docs.unionByName(docs.limit(5)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = store(stage(spark, docs, SF001))
        assert out.columns == docs.columns
        before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
        assert set(after) <= set(before) and after
        if name == "exact_dedup":
            best = {}
            for i, t in before:
                best[fold(t)] = max(best.get(fold(t), (i, t)), (i, t))
            assert sorted(after) == sorted(best.values())
        if name == "near_dedup":
            assert sorted(repr(i) for i, _ in after) == sorted(x[1:].split(",")[0] for x in near_brute(before, 5) if x.endswith("True)"))
        docs = out
    assert corpus_pipeline.bpe(spark, docs, SF001).count() == docs.count()


def test_near_dedup_with_several_texts_of_one_id(spark):
    words = ["w%d" % i for i in range(400)]
    clean, first = " ".join(words[200:]), " ".join(words[:200])
    copy = first.replace("w150 ", "other ")
    rows = [(7, clean), (7, copy), (1, first), (8, clean.replace("w390 ", "other "))]
    docs = store(spark.createDataFrame(rows, "doc_id long, text string"))
    got = corpus_pipeline.near_dedup(spark, docs, SF001).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, first), (7, clean)])
    signed = near_dedup.signatures(docs, 5, "doc_id", "text").withColumn("cls", F.xxhash64("digest"))
    classes = signed.withColumnRenamed("doc_id", "rep")
    sets = near_dedup.class_sets(classes, classes, docs, 5, "doc_id", "text", near_dedup.set_digest).collect()
    assert sorted((r.cls, bytes(r["items"])) for r in sets) == sorted((r.cls, bytes(r.digest)) for r in signed.collect())
