"""The pipeline operators against brute force, on rows with nulls, copies, ties and clashing columns."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import bpe, embedding_dedup, exact_dedup, mixing, near_dedup, records, sharding, substring_dedup, toxicity, warc
from shelfcast.llm.common import components, file_system, prepare, shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, part int, bucket int, cls string"


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    near = [t.split() for t in base if len(t.split()) > 40][:6]
    out = base + base[:9] + [t.upper() for t in base[:4]]
    for t in near:
        for _ in range(12):
            c = list(t)
            c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    passage = " ".join(rng.choice(words) for _ in range(30))
    out += [f"{t}\n{passage}\t{u}" for t, u in zip(base[10:20], base[20:30])]
    out += [None, None, "", "   ", "é 中文 😀", "long " * 3000, "x" * 5000]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (None, "only null id"), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    data = [(i, t, "en", None if n % 7 == 0 else f"s{n % 4}", 0, 1, "k", 2, 3, "c") for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).repartition(7).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, empty, rows):
    got = sharding.assign_shards(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign_shards(empty).count() == 0


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2 ** 63, 20_000).astype(np.uint64)
    for n in (1, 2, 9, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02


def scalar_jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_scalar_loop():
    keys = np.random.default_rng(8).integers(0, 2 ** 64, 3000, dtype=np.uint64)
    for n in (1, 2, 39, 40, 41, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]


def fold(t):
    return (t or "").encode().translate(near_dedup.FOLD)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, empty, rows, keep, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    pick = max if keep == "largest" else min
    want = []
    for i, t in rows:
        g = groups[fold(t)]
        first = pick((x for x in g if x is not None), default=None)
        want.append(repr((i, first, len(g), i == first, hashlib.sha256(fold(t)).hexdigest())))
    assert sorted(map(repr, map(tuple, exact_dedup.exact_duplicates(docs, keep).collect()))) == sorted(want)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_merged_runs_hold_a_key_once():
    rng = random.Random(9)
    keys = sorted(hashlib.sha256(str(rng.randint(0, 4000)).encode()).digest() for _ in range(9000))
    rows = [{"run": 0, "slice": 0, "digest": k, "check": k[0], "bytes": 3, "keep_id": i, "n": 1} for i, k in enumerate(keys)]
    schema = exact_dedup.pa.schema([("run", "int32"), ("slice", "int32"), ("digest", "binary"), ("check", "int64"), ("bytes", "int64"), ("keep_id", "int64"), ("n", "int64")])
    for size in (1, 7, 1500, 2000):
        batches = exact_dedup.pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=size)
        got = [(r["digest"], r["keep_id"], r["n"]) for b in exact_dedup.merge_run("largest")(batches) for r in b.to_pylist()]
        assert sorted(got) == sorted((k, keys.index(k) + keys.count(k) - 1, keys.count(k)) for k in set(keys))


def near_brute(rows, k):
    def shingles(t):
        w = fold(t).split()
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= 80 * len(x | y):
                up[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for n, (i, s) in enumerate(sets):
        c = i if i is None else min(sets[m][0] for m in range(len(sets)) if find(m) == find(n))
        out.append(repr((i, len(s), c, i is None or i == c)))
    return sorted(out)


@pytest.mark.parametrize("limit,passes,block", [(128, near_dedup.PASSES, 4096), (3, ((2, 1), (20, 2)), 4096), (2, ((2, 1), (20, 1)), 2)])
def test_near_dedup(docs, empty, rows, limit, passes, block):
    got = near_dedup.near_duplicates(docs, 4, limit=limit, passes=passes, block=block)
    assert sorted(map(repr, map(tuple, got.collect()))) == near_brute(rows, 4)
    if limit == 128:
        assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_compares_pairs_whose_sketches_agree_less(spark):
    a, b = np.arange(near_dedup.SKETCH, dtype=np.uint32), np.arange(near_dedup.SKETCH, dtype=np.uint32)
    b[35:] += 1000
    pair = spark.createDataFrame([(1, c, c, bytearray(x.tobytes()), 10) for c, x in ((1, a), (2, b))], "node long, cls long, comp long, sketch binary, n long")
    assert sorted(r.cls for r in near_dedup.similar_units(pair).collect()) == [1, 2]
    bits = np.zeros((3, near_dedup.WIDE), np.uint8)
    bits[1, :near_dedup.WIDE - near_dedup.LEAST_WIDE] = 1
    bits[2, :near_dedup.WIDE - near_dedup.LEAST_WIDE + 1] = 1
    schema = "pair long, node long, cls long, comp long, odd boolean, own boolean, other boolean, n long, wide binary, nodes array<long>"

    def found(nodes):
        rows = [(1, 5, c, c, c == 0, c == 0, True, 10, bytearray(np.packbits(x).tobytes()), n) for c, (x, n) in enumerate(zip(bits, nodes))]
        got = near_dedup.similar_pairs(spark.createDataFrame(rows, schema)).collect()
        return ([(r.cls, np.frombuffer(r.partners, np.int64).tolist()) for r in got if r.partners], sorted(r.cls for r in got if not r.partners))

    assert found([[5], [5], [5]]) == ([(0, [1])], [0, 1])
    assert found([[3, 5], [4, 5, 6], [5]]) == ([(0, [1])], [0, 1])
    assert found([[3, 5], [3, 5], [5]]) == ([], [])  # met in node 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in components(edges, "a", "b").collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_records_round_trip(spark, docs, empty, rows):
    prepare(spark)
    folder = shared_folder(spark, "records")
    manifest = records.write_records(docs, folder)
    got = records.read_records(manifest, folder).orderBy("start").collect()
    encode = records.LibraryEncoder(records.VOCABULARY)
    want = sorted((i if i is not None else -1, encode.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    name = manifest.orderBy(F.desc("records")).first()["name"]
    forward = records.read_at(folder, name, range(5))
    assert records.read_at(folder, name, [4, 2, 0]) == [forward[i] for i in (4, 2, 0)]
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{name}.rec") as f:
        data = bytearray(f.read())
    data[13] ^= 1
    with system.open_output_stream(f"{path}/bad.rec") as f:
        f.write(bytes(data))
    with system.open_input_file(f"{path}/bad.rec") as f, pytest.raises(ValueError):
        records.read_frame(f)
    folder = shared_folder(spark, "records")
    assert records.read_records(records.write_records(empty, folder), folder).count() == 0


def test_records_have_the_ids_of_the_plain_library_call():
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path(records.VOCABULARY))
    rng = random.Random(6)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x's\n", "", "<|endoftext"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", " word", "word. ", " ", "\n", "é", "中", "'s", "12"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = records.LibraryEncoder(records.VOCABULARY).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in np.frombuffer(got[0], "<u2")


def test_warc_round_trip(spark, monkeypatch):
    prepare(spark)
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 4000, "<p>a</p>", "tail\r\n\r\nWARC/1.1"]
    data = [(i, None if i % 5 == 0 else f"http://x/{i}\r\n", html[i % len(html)], "clash") for i in range(60)] + [(None, "u", "<p>a</p>", "c"), (None, "u", "alone", "c")]
    data += [(3, "again", "<p>a</p>", "c"), (3, "again", "<p>a</p>", "c"), (59, "again", "<p>a</p>", "c"), (3, "again", "other", "c")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, size string").repartition(3)
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=5000)
    assert index.agg(F.max("frame")).first()[0] > 2
    largest = {}
    for i, _, h, _ in data:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in data:
        b, top = (h or "").encode(), largest[h or ""]
        revisit = top >= 0 and i != top
        want.append(repr((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(map(repr, map(tuple, warc.read_bundles(index, folder).collect()))) == sorted(want)
    monkeypatch.setattr(warc, "STRETCH", 1)
    assert warc.read_bundles(index, folder).select(F.spark_partition_id()).distinct().count() > 1
    place = index.where("page_id = 53").first()
    assert warc.read_record(folder, place.bundle, place.frame, place.offset)["Page-Id"] == "53"
    empty = warc.write_bundles(pages.limit(0), folder)
    assert warc.read_bundles(empty, folder).count() == 0


def test_mixing(spark, docs, empty, rows):
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 50)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = mixing.mix(docs, marks).collect()
    total = sum(len((t or "").split()) for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.source_size, []).append(r)
        assert r.taken == r.passes * r.size <= 2 * r.size
    assert sum(r.size for r in got) == total
    targets = {r.source_size: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for size, part in by.items():
        assert targets[size] <= 2 * size + 1e-6
        assert abs(sum(r.taken for r in part) - targets[size]) <= max(r.size for r in part)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3), marks).collect()))
    assert mixing.mix(empty, marks).count() == 0


def strip_brute(rows, n=13):
    top = 1 << 62
    starts, out = {}, []
    docs = [(top if i is None else i, [w for w in (t or "").encode().split()]) for i, t in rows]
    for i, w in docs:
        for p in range(len(w) - n + 1):
            x = tuple(w[p:p + n])
            starts[x] = min(starts.get(x, i), i)
    for i, w in docs:
        gone = set()
        for p in range(len(w) - n + 1):
            if starts[tuple(w[p:p + n])] < i:
                gone.update(range(p, p + n))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append(repr((None if i == top else i, len(w), len(gone), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("part_bytes,hot", [(8 << 20, 4096), (2000, 4096), (2000, 10 ** 9)])
def test_substring_dedup(docs, empty, rows, part_bytes, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = substring_dedup.remove_repeats(docs, part_bytes=part_bytes)
    assert sorted(map(repr, map(tuple, got.collect()))) == strip_brute(rows)
    if hot == 4096 and part_bytes > 2000:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_equal_window_hashes_are_told_apart_by_their_words():
    text = b"a b c\na b d\na b c"
    order, cls = substring_dedup.equal_windows(text, np.array([0, 6, 12]), np.array([5, 11, 17]), np.zeros(3, np.uint64))
    assert cls[list(order).index(0)] == cls[list(order).index(2)] != cls[list(order).index(1)]


def test_toxicity_on_held_out_rows(spark, empty):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.join(d.select("doc_id", "text"), "doc_id")
    got = toxicity.score_documents(known, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
    positives, negatives = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([p > n for p in positives for n in negatives]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 20000), (3, "word " * 20000)], "doc_id long, text string")
    scores = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score_documents(empty, labels.limit(0)).count() == 0


def test_toxicity_sample_has_all_texts_and_long_ones(spark, monkeypatch):
    kept, long = [], []
    monkeypatch.setattr(toxicity, "DICTIONARY_WINDOWS", 40, raising=False)
    train, calibrate = toxicity.train_dictionary, toxicity.CompressionModel.calibrate
    monkeypatch.setattr(toxicity, "train_dictionary", lambda samples, *a: kept.append(samples) or train(samples, *a))
    monkeypatch.setattr(toxicity.CompressionModel, "calibrate", lambda self, texts, *a: long.extend(t for t in texts if len(t) > 16 << 10) or calibrate(self, texts, *a))
    data = [(i, " ".join(f"w{i}x{j}" for j in range(300)), 0) for i in range(30)] + [(100 + i, f"bad{i} " * 50, 1) for i in range(8)]
    data += [(200 + i, f"long{i} " * 4000, i % 2) for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    assert toxicity.train(docs.drop("toxic"), docs.drop("text")) is not None
    used = [i for i, _, t in data if i < 30 and not zlib.crc32(str(i).encode()) % toxicity.FOLDS == 0]
    names = {w.split(b"x")[0] for w in kept[0]}
    assert len(kept[0]) == 40 and len(names) == len(used) - max(1, round(len(used) / 4))
    assert {t.split()[0] for t in long} == {b"long%d" % i for i in range(20) if zlib.crc32(str(200 + i).encode()) % toxicity.FOLDS}


def brute_links(vectors):
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [(i, x / np.sqrt(x @ x)) for i, x in ok]
    links, comp = [0] * len(unit), list(range(len(unit)))
    for a in range(len(unit)):
        for b in range(len(unit)):
            if a != b and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.9:
                links[a] += 1
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    least = {c: min(unit[m][0] for m in range(len(unit)) if comp[m] == c) for c in set(comp)}
    return [(unit[n][0], links[n], least[comp[n]]) for n in range(len(unit))]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    data = [(i, (centres[i % 30] + 0.15 * rng.normal(size=24)).tolist()) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(40)] + [(400, None), (401, [0.0] * 24), (402, [float("nan")] + [1.0] * 23), (403, [None] + [1.0] * 23), (404, [1.0, 0.0]), (405, [2.0, 0.0]), (None, data[0][1])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("cls", F.lit("x"))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    want = {i: (n, c) for i, n, c in brute_links(exact)}
    got = embedding_dedup.near_vectors(frame).collect()
    assert len(got) == len(data)
    for r in got:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (n, c, r.vec_id is None or c == r.vec_id)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_embedding_dedup_with_several_vectors_of_one_id(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 16))
    data = [(5, a.tolist()), (5, b.tolist()), (5, b.tolist()), (9, (a + 0.05 * c).tolist()), (9, (b + 0.05 * c).tolist()), (2, (b - 0.05 * a).tolist()), (7, c.tolist())]
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute_links(data))


@pytest.mark.parametrize("functions", [2, 3])
def test_embedding_recall_where_a_table_joins_several_functions(spark, monkeypatch, functions):
    dims, pairs = 64, 400
    rng = np.random.default_rng(functions)
    x, z = rng.normal(size=(2, pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.905 * x + math.sqrt(1 - 0.905 ** 2) * z
    data = [(2 * i, v.tolist()) for i, v in enumerate(x)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(y)]
    monkeypatch.setattr(embedding_dedup, "PER_BUCKET", 2 * pairs / 128.0 ** functions)
    seen, real = [], embedding_dedup.bucket_rows
    monkeypatch.setattr(embedding_dedup, "bucket_rows", lambda v, t, f, a: seen.append(f) or real(v, t, f, a))
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    linked = [r.vec_id for r in got if r.n_links]
    assert seen == [functions] and len(linked) >= 0.9 * 2 * pairs
    assert all(r.component_id == r.vec_id // 2 * 2 for r in got if r.n_links)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    data = [(i, (np.ones(8) + 0.1 * rng.normal(size=8)).tolist()) for i in range(50)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == set(brute_links(data))


def test_bpe_matches_the_library(docs, empty, rows):
    import public_tokenizers
    import tiktoken
    codec = bpe.codec(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("aab  é\n\t中1'sđ😀\x00\x1c\x85　<|endoftext|>.,ß½²") for _ in range(rng.randint(0, 300)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    long = "ab" * 20_000 + "q" * 20_000
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == library.encode_ordinary(long)
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append(repr((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert sorted(map(repr, map(tuple, bpe.encode_decode(docs).collect()))) == sorted(want)
    assert bpe.encode_decode(empty).count() == 0
