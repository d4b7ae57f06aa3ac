"""Every pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from shelfcast.llm import bpe, mixing, toxicity
from shelfcast.llm.common import store, table
from tests.llm.test_operators import fold, near_brute

#: Besides the columns of documents, names that the operators use themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size int, kept string, part int, cls string, digest string, passes int, score double, quality string, ids string")
BASE = " ".join(f"w{i}" for i in range(60))
CASES = [(1, BASE), (2, BASE.upper()), (3, BASE.replace("w59", "other")), (4, ""), (5, None), (6, " \t "), (7, "a b"), (9, "a b"),
         (8, "very long " * 30_000), (1, BASE), (1, BASE), (None, None), (None, "alone"), (None, BASE), (10, "é 中文 😀")]


def texts():
    rng = random.Random(3)
    plain = [" ".join(rng.choice(["river", "stone", "paper", "cloud", "green", "window"]) + str(rng.randint(0, 30)) for _ in range(50)) for _ in range(60)]
    vile = [" ".join(rng.choice(["stone", "paper", "vile", "filth", "scum"]) for _ in range(50)) for _ in range(30)]
    return CASES + [(100 + i, t) for i, t in enumerate(plain)] + [(200 + i, t) for i, t in enumerate(vile)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    marks = [(i, "en", int(i >= 200), i % 2) for i, _ in texts() if i is not None and i >= 100]
    marks += [(7, None, None, None), (None, "en", 1, 1), (100, "en", 0, 0), (999, "en", 1, 0)]
    spark.createDataFrame(marks, "doc_id long, lang string, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None, n, "k", 1, "c", None, 9, 0.5, "q", "x")
            for n, (i, t) in enumerate(texts())]
    return store(spark.createDataFrame(rows, SCHEMA).repartition(3))


def applied(stage, spark, docs, sf_dir):
    """Input and output rows of a stage; its rows are the input's, unchanged in every column."""
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    before, after = docs.collect(), out.collect()
    assert set(map(tuple, after)) <= set(map(tuple, before))
    return [(r.doc_id, r.text) for r in before], [(r.doc_id, r.text) for r in after]


def test_toxicity_stage_equals_a_plain_loop_over_the_model(spark, docs, sf_dir):
    before, after = applied(corpus_pipeline.toxicity, spark, docs, sf_dir)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    scores = {t: model.score((t or "").encode()) for _, t in before}
    assert Counter(after) == Counter(x for x in before if scores[x[1]] < 0.5)
    assert {i for i, _ in before} - {i for i, _ in after} >= {i for i, _ in before if i is not None and i >= 200}
    got = toxicity.score_documents(docs, labels).collect()
    assert Counter((r.doc_id, r.score) for r in got) == Counter((i, scores[t]) for i, t in before)
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_exact_stage(spark, docs, sf_dir):
    before, after = applied(corpus_pipeline.exact_dedup, spark, docs, sf_dir)
    best = {}
    for i, t in before:
        best[fold(t)] = max(best.get(fold(t), -1), -1 if i is None else i)
    assert Counter((fold(t), -1 if i is None else i) for i, t in after) == Counter(best.items())


def test_near_stage(spark, docs, sf_dir):
    before, after = applied(corpus_pipeline.near_dedup, spark, docs, sf_dir)
    assert sorted(repr(i) for i, _ in after) == sorted(x[1:].split(",")[0] for x in near_brute(before, 5) if x.endswith("True)"))


def test_mixing_stage(spark, docs, sf_dir):
    before, after = applied(corpus_pipeline.mixing, spark, docs, sf_dir)
    passes = {}
    for r in mixing.mix(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).collect():
        passes[r.doc_id] = max(passes.get(r.doc_id, 0), r.passes)
    assert Counter(after) == Counter(x for x in before for _ in range(passes[x[0]]))


def test_bpe_stage(spark, docs, sf_dir):
    import public_tokenizers
    import tiktoken
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(bpe.VOCABULARY).ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in docs.collect())
    got = corpus_pipeline.bpe(spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, tuple(memoryview(bytes(r.ids)).cast("I"))) for r in got) == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_documents(spark, docs, sf_dir, name, stage):
    none = docs.limit(0)
    out = stage(spark, none, sf_dir)
    assert out.count() == 0 and (name == "bpe" or out.columns == none.columns)


def test_without_labels(spark, docs, tmp_path):
    table_of = spark.createDataFrame([], "doc_id long, lang string, toxic int, quality int")
    table_of.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).columns == docs.columns
