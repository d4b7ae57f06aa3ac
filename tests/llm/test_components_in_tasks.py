"""Components joined inside tasks; full shingle sets sent once, straight to the units that confirm them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import common, near_dedup
from shelfcast.llm.common import prepare


def exchanges(frame, kind="Exchange hashpartitioning"):
    return frame._jdf.queryExecution().executedPlan().toString().count(kind)


def test_components_of_edges_that_fit_a_task_are_not_shuffled(spark):
    prepare(spark)
    edges = spark.createDataFrame([(5, 9), (9, 7), (7, 5), (4, 4), (20, 21), (21, 20), (3, 21)], "a long, b long")
    got = common.components(edges, "a", "b")
    assert exchanges(got) == 0
    assert sorted(map(tuple, got.collect())) == [(3, 3), (5, 5), (7, 5), (9, 5), (20, 3), (21, 3)]
    assert common.components(edges.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_components_of_more_edges_than_a_task_takes(spark, monkeypatch, limit):
    prepare(spark)
    monkeypatch.setattr(common, "EDGES_IN_TASK", limit)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(-5, 129)]
    edges = spark.createDataFrame(chain + chain[::3], "a long, b long").repartition(5)
    got = {r.node: r.component for r in common.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: -5 for i in range(100, 130)}, -5: -5}


def test_near_dedup_sets_travel_straight_to_their_units(spark):
    prepare(spark)
    words = " ".join(f"w{i}" for i in range(60))
    texts = [words, words + " x", words + " x y", "a b c d e f", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = (near_dedup.signatures(docs, 4, "doc_id", "text").where("digest IS NOT NULL")
               .select(F.xxhash64("digest").alias("cls"), F.col("doc_id").alias("rep"), "digest", "n_shingles").cache())
    cls = {r.rep: r.cls for r in classes.collect()}
    named = spark.createDataFrame([(u, cls[d], cls[d]) for u, d in ((1, 0), (1, 1), (2, 1), (2, 2), (3, 3), (3, 0))], "unit long, cls long, comp long")
    got = near_dedup.class_sets(named, classes, docs, 4, "doc_id", "text", np.ndarray.tobytes, "unit").collect()
    assert sorted((r.unit, r.cls) for r in got) == sorted((r.unit, r.cls) for r in named.collect())
    links = near_dedup.exact_links(named, classes, docs, 4, "doc_id", "text")
    # the sets travel by the unit alone; before, they were collected by class and sent on
    assert exchanges(links) == 1
    assert sorted(sorted(map(int, r)) for r in links.collect()) == sorted([sorted([cls[0], cls[1]]), sorted([cls[1], cls[2]])])
