"""Repeated passages: super-k-mer partitioning of word windows.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash among its runs of
``MINIMISER`` words, so equal windows have equal minimisers, and consecutive windows mostly share
theirs.  A stretch of windows with one minimiser (a super-k-mer) travels as one packed string to
the bucket of the minimiser, instead of once per window.  In a bucket the windows are sorted and
equal ones counted exactly, by their words.

Documents are dealt to parts of about ``PART_BYTES`` by a hash of the id.  A part sends each
distinct string of its documents once, with the smallest and largest id it occurs in there: a
passage that fills a third of the corpus is one string per part in its bucket, however many
documents hold it.  A minimiser that very many different strings share (a frequent line in changing
surroundings) would be one large bucket; its windows are dealt out by all their words instead.
The bucket answers to each part with the windows that start in a smaller
document, and the part removes the words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import groups, hash_words, mix64, prepare, store, table, text_bytes, window_hashes

WINDOW = 13
MINIMISER = 3
PART_BYTES = 8 << 20
#: Buckets for each part; packed strings repeat the words at their borders, about three times the text.
BUCKETS_PER_PART = 3
#: A minimiser with one in ``HOT`` of all packed strings does not get a bucket of its own.
HOT = 4096
FILTER_BITS = 20
#: Stands for a null id: no document is smaller than, or as small as, a document without id.
NO_ID = np.iinfo(np.int64).max


def minimisers(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """The smallest hash of the ``window - k + 1`` k-word runs in each window."""
    runs = window_hashes(hashes, k)
    span, width = window - k + 1, 1
    while 2 * width <= span:
        runs = np.minimum(runs[:-width], runs[width:])
        width *= 2
    if width < span:
        runs = np.minimum(runs[:len(runs) - (span - width)], runs[span - width:])
    return runs


def hot_minimisers(docs: DataFrame, window: int, k: int) -> np.ndarray:
    """Minimisers of at least one in ``HOT`` super-k-mers of the corpus; so there are ``HOT`` at most.

    Every batch of documents reports those that reach half this share among its own, with their
    counts; a minimiser that is hot in the corpus but spread so thinly that too few batches report
    it stays a (larger) bucket.  What counts as hot changes the buckets, never the result.
    """
    def run(batches):
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                hashes, _, _ = hash_words(text)
                if len(hashes) >= window:
                    low = minimisers(hashes, window, k)
                    keys.append(low[np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))])
            if keys:
                keys, counts = np.unique(np.concatenate(keys), return_counts=True)
                total = counts.sum()
                pick = (counts > 1) & (2 * HOT * counts >= total)
                yield pa.RecordBatch.from_arrays([pa.array(keys[pick].view(np.int64)), pa.array(counts[pick]), pa.array(np.zeros(pick.sum(), np.int64))], ["key", "n", "total"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([total])], ["key", "n", "total"])

    counts = store(docs.mapInArrow(run, "key bigint, n bigint, total bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = counts.agg(F.sum("total")).first()[0] or 0
    return np.array([r["key"] for r in counts.where(F.col("key").isNotNull() & (F.col("n") * HOT >= total)).collect()], np.int64).view(np.uint64)


def super_k_mers(text: bytes, buckets: int, window: int, k: int, hot: np.ndarray):
    """Buckets and packed strings of the maximal stretches of windows that share a minimiser.

    The words of ``text`` are parted by single spaces.  A window whose minimiser is hot goes alone,
    to the bucket of all its words.
    """
    hashes, begins, ends = hash_words(text)
    if len(hashes) < window:
        return (), ()
    low = minimisers(hashes, window, k)
    if len(hot):
        alone = np.flatnonzero(np.isin(low, hot))
        low[alone] = mix64(window_hashes(hashes, window)[alone])
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    last = np.concatenate([first[1:], [len(low)]]) + (window - 2)
    bucket = mix64(low[first]) % np.uint64(buckets)
    return bucket.tolist(), map(text.__getitem__, map(slice, begins[first].tolist(), ends[last].tolist()))


def equal_windows(text: bytes, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort windows; return (order, class of each window in that order) with equal classes for equal bytes."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    cls = np.cumsum(new)
    head = order[np.flatnonzero(new)][cls - 1]
    many = np.flatnonzero(order != head)  # a window whose hash no other has needs no check
    a, b = order[many], head[many]
    if any(text[p:q] != text[r:s] for p, q, r, s in zip(*(x.tolist() for x in (begins[a], ends[a], begins[b], ends[b])))):
        # two windows with one hash: number them by their bytes
        numbers: dict[bytes, int] = {}
        cls = np.array([numbers.setdefault(text[p:q], len(numbers)) for p, q in zip(begins.tolist(), ends.tolist())])
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
    return order, cls


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64))


def packed(numbers: list[int]) -> bytes:
    """Ids as zstandard-compressed differences: the strings come in the order of their documents."""
    return zstandard.ZstdCompressor().compress(np.diff(np.array(numbers, np.int64), prepend=np.int64(0)).tobytes())


def send_strings(parts, buckets: int, window: int, k: int, hot: np.ndarray) -> DataFrame:
    """(part, bucket, strings, lo, hi): what each part sends to each bucket."""

    def pack(rows: pa.Table) -> pa.Table:
        compress = zstandard.ZstdCompressor().compress
        first: dict[int, dict[bytes, int]] = defaultdict(dict)
        last: dict[int, dict[bytes, int]] = defaultdict(dict)
        rows = rows.sort_by("doc_id")
        for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            for bucket, string in zip(*super_k_mers(b" ".join(text.split()), buckets, window, k, hot)):
                if first[bucket].setdefault(string, doc) != doc:
                    last[bucket][string] = doc
        part = rows.column("part")[0].as_py()
        out = [(part, b, compress(b"\n".join(s)), packed(list(s.values())), packed([last[b].get(x, d) for x, d in s.items()] if b in last else list(s.values())))
               for b, s in first.items()]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = zip(*out) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "bucket", "strings", "lo", "hi"])

    return parts.groupBy("part").applyInArrow(pack, "part int, bucket bigint, strings binary, lo binary, hi binary")


def answer(sent: DataFrame, window: int) -> DataFrame:
    """(part, windows, lo): per bucket and part, hashes of windows that start in a smaller document than
    the largest that has them in the part, and the smallest document each starts in."""

    def count(batches):
        decompress = zstandard.ZstdDecompressor().decompress
        for bucket in groups(batches, "bucket"):
            blobs, lo, hi, part = [], [], [], []
            for p, blob, a, b in zip(*(bucket.column(c).to_pylist() for c in ("part", "strings", "lo", "hi"))):
                blobs.append(decompress(blob))
                lo.append(unpacked(a))
                hi.append(unpacked(b))
                part.append(np.full(len(lo[-1]), p))
            lo, hi, part = map(np.concatenate, (lo, hi, part))
            text = b"\n".join(blobs)  # a string per line
            words, begins, ends = hash_words(text)
            of = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), begins)  # the string of each word
            starts = np.flatnonzero(of[:len(of) - window + 1] == of[window - 1:])
            hashes = window_hashes(words, window)[starts]
            order, cls = equal_windows(text, begins[starts], ends[starts + window - 1], hashes)
            string = of[starts[order]]
            cuts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
            smallest = np.repeat(np.minimum.reduceat(lo[string], cuts), np.diff([*cuts, len(cls)]))
            again = np.flatnonzero(smallest < hi[string])
            if not len(again):
                continue
            to = part[string[again]]
            by_part = np.argsort(to, kind="stable")
            again, to = again[by_part], to[by_part]
            bounds = [*np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist(), len(to)]
            found, least = hashes[order[again]], smallest[again]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(to[a]) for a in bounds[:-1]], pa.int32()),
                 pa.array([found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                 pa.array([least[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["part", "windows", "lo"])

    sorted_buckets = sent.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_buckets.mapInArrow(count, "part int, windows binary, lo binary")


def strip(parts, answers: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Remove from each part's documents the words of the windows it was told of."""

    def apply(rows: pa.Table, told: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(told.column("windows").to_pylist()), np.uint64)
        least = np.frombuffer(b"".join(told.column("lo").to_pylist()), np.int64)
        order = np.lexsort((least, found))
        found, least = found[order], least[order]
        told_of = np.zeros(1 << FILTER_BITS, bool)  # most windows are not among them
        told_of[found & np.uint64((1 << FILTER_BITS) - 1)] = True
        out = []
        for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            text = b" ".join(text.split())
            hashes, _, _ = hash_words(text)
            n = kept_words = len(hashes)
            if n >= window and len(found):
                hashes = window_hashes(hashes, window)
                maybe = np.flatnonzero(told_of[hashes & np.uint64((1 << FILTER_BITS) - 1)])
                at = np.minimum(np.searchsorted(found, hashes[maybe]), len(found) - 1)
                starts = maybe[(found[at] == hashes[maybe]) & (least[at] < doc)]
                if len(starts):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = [w for w, g in zip(text.split(), gone.tolist()) if not g]
                    text, kept_words = b" ".join(kept), len(kept)
            out.append((None if doc == NO_ID else doc, n, n - kept_words, hashlib.sha256(text).hexdigest(), text if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out)) if out else [[]] * 5
        columns[4] = [None if t is None else t.decode() for t in columns[4]]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        apply, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER, part_bytes: int = PART_BYTES,
                   with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text.

    Removed are the words that a window covers whose words also start in a document of a smaller
    id; windows are those of the input.  Inside a part, windows are told apart by 64-bit hashes of
    their words; in the buckets, where they are counted, by the words.

    A null text has no words.  A null id is larger than all others and equal to other null ids.
    Rows that repeat an id are one document in this: neither loses words to the other.
    """
    prepare(docs.sparkSession)
    text = text_bytes(text_col)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    parts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc_id"), text.alias("text"))
    hot = hot_minimisers(docs.select(text.alias("text")), window, k)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    answers = answer(send_strings(parts, n * BUCKETS_PER_PART, window, k, hot), window)
    rows = strip(parts, answers, window, with_text)
    return rows if with_text else rows.drop("kept_text")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, pos, words[pos] AS word,
             CASE WHEN pos + 12 <= len(words) THEN array_to_string(words[pos:pos + 12], ' ') END AS win
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS pos FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT w.doc_id, w.pos, w.word, coalesce(f.first < w.doc_id, false) AS again FROM w LEFT JOIN f USING (win)),
c AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
