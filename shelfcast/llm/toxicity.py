"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, calibrated."""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import WordHashes, mix64, prepare, store, table, text_bytes, window_hashes

#: The bounded sample of labelled rows on which the classifier is fitted: rows per class for the
#: dictionaries and for the calibration, the longest text (in bytes) of these, and the longer texts
#: per class that go whole into the calibration besides.
DICTIONARY_TOXIC, DICTIONARY_ORDINARY = 1500, 4500
CALIBRATION_TOXIC, CALIBRATION_ORDINARY = 500, 1500
SAMPLE_TEXT_BYTES = 16 << 10
LONG_TEXTS = 100
#: Ordinary windows on which the dictionary is trained, taken evenly from all sample texts.
DICTIONARY_WINDOWS = 50_000
#: Bytes of the two dictionaries' parts, of a window, and the compression level.
ORDINARY_BYTES, TOXIC_BYTES = 32768, 2048
WINDOW_BYTES = 100
LEVEL = 9
FOLDS = 5


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(text: bytes, size: int = WINDOW_BYTES) -> list[bytes]:
    """The whole text as runs of whole words of about ``size`` bytes; one empty window at least."""
    out, run, n = [], [], 0
    for word in words(text):
        run.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" ".join(run))
            run, n = [], 0
    if run or not out:
        out.append(b" ".join(run))
    return out


def without_copies(texts: list[bytes], hashes: int = 8, k: int = 5) -> list[bytes]:
    """Leave out texts that share a minimum of their word shingles with an earlier one.

    Groups of near copies would otherwise fill the dictionaries with their accidental words.
    """
    known, seen, out = WordHashes(), set(), []
    seeds = mix64(np.arange(1, hashes + 1, dtype=np.uint64))
    for text in texts:
        w = known.array(words(text))
        shingles = window_hashes(w, min(k, max(1, len(w))))
        if len(shingles):
            marks = {(i, int(mix64(shingles ^ seed).min())) for i, seed in enumerate(seeds)}
            if not marks & seen:
                out.append(text)
            seen |= marks
    return out


def evenly(items: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of the items, at equal distances."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def train_dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary of ``samples``; with too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class CompressionModel:
    """Two dictionaries and the weights that turn window lengths into a score."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights = self.mean = self.scale = None
        self._compress = None

    def __getstate__(self):
        return {**self.__dict__, "_compress": None}

    def lengths(self, text: bytes) -> np.ndarray:
        """Per window: bytes that the toxic dictionary saves over the ordinary one."""
        if self._compress is None:
            self._compress = compressor(self.ordinary), compressor(self.toxic)
        ordinary, toxic = self._compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], float)

    def features(self, text: bytes) -> list[float]:
        saved = self.lengths(text)
        n = len(saved)
        return [saved.mean(), saved.max(), *(math.log((saved >= t).mean() + 1 / (n + 20)) for t in range(1, 7)),
                math.log(n), (saved < 0).mean()]

    def calibrate(self, texts: list[bytes], labels: np.ndarray, sample_weights: np.ndarray) -> None:
        """Logistic regression (ridge, damped Newton steps) of the label on the windows' saved bytes."""
        x = np.array([self.features(t) for t in texts])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w, ridge = np.zeros(z.shape[1]), 0.1
        for _ in range(100):
            p = sigmoid(z @ w)
            slope = z.T @ (sample_weights * (labels - p)) - ridge * w
            curve = (z * (sample_weights * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w += step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        self.weights = w

    def score(self, text: bytes) -> float:
        z = (np.array(self.features(text)) - self.mean) / self.scale
        return float(sigmoid(self.weights[0] + z @ self.weights[1:]))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def compressor(content: bytes):
    frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW_BYTES, dict_size=len(content), **frame)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress


def fit(toxic: list[bytes], ordinary: list[bytes], toxic_share: float,
        long_toxic: list[bytes] = [], long_ordinary: list[bytes] = []) -> CompressionModel | None:
    """Train on labelled sample texts; None without texts of both classes.

    The ordinary dictionary is trained on windows of ordinary text.  The toxic one is trained on
    the words of toxic texts that no ordinary sample text has and that several toxic ones share,
    and goes on with the ordinary content: what both classes have in common then compresses alike
    with either, and only toxic wording makes a difference.  A fourth of each class is kept for
    the calibration, weighted to the share that the label has in all training rows; the long texts
    are for the calibration alone and count there as one text of the sample each.
    """
    if not toxic or not ordinary:
        return None
    part = CALIBRATION_TOXIC / (CALIBRATION_TOXIC + DICTIONARY_TOXIC)
    cut_t, cut_o = max(1, round(len(toxic) * part)), max(1, round(len(ordinary) * part))
    base_t, base_o = without_copies(toxic[cut_t:] or toxic), without_copies(ordinary[cut_o:] or ordinary)
    common = {w for t in base_o for w in set(words(t))}
    counts = Counter(w for t in base_t for w in set(words(t)) - common)
    least = max(3, math.ceil(0.01 * len(base_t)))
    own = [(b" " + w + b" ").ljust(8) for t in base_t for w in sorted(set(words(t))) if counts[w] >= least]
    random.Random(0).shuffle(own)  # the trainer wants every part of its material to be alike
    base = train_dictionary(evenly([w for t in base_o for w in windows(t, 200)], DICTIONARY_WINDOWS), ORDINARY_BYTES, 200, 8)
    extra = train_dictionary(own, TOXIC_BYTES, 16, 6) if own else b""
    model = CompressionModel(base, extra + base)
    texts = toxic[:cut_t] + long_toxic + ordinary[:cut_o] + long_ordinary
    labels = np.repeat([1.0, 0.0], [cut_t + len(long_toxic), cut_o + len(long_ordinary)])
    share = min(max(toxic_share, 1e-3), 1 - 1e-3)
    weights = np.concatenate([
        p / (len(short) + len(long)) * np.repeat([len(short) / cut, 1.0], [cut, len(long)])
        for p, short, cut, long in ((share, toxic, cut_t, long_toxic), (1 - share, ordinary, cut_o, long_ordinary))]) * len(texts)
    model.calibrate(texts, labels, weights)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CompressionModel | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The sample is chosen by a hash of the id, so reruns agree; only its ids are broadcast and only
    its texts reach the driver, both bounded by the parameters above.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {1: DICTIONARY_TOXIC + CALIBRATION_TOXIC, 0: DICTIONARY_ORDINARY + CALIBRATION_ORDINARY}
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order).limit(sizes[1]).unionByName(known.where("toxic = 0").orderBy(order).limit(sizes[0]))
    sample = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
                   .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))
    short = F.octet_length("text") <= SAMPLE_TEXT_BYTES

    def texts(rows: DataFrame, most: int) -> list[bytes]:
        return [bytes(r["text"]) for r in rows.orderBy(order).limit(most).select("text").collect()]

    short_texts, long_texts = ([texts(sample.where(F.col("toxic") == t).where(which), most[t]) for t in (0, 1)]
                               for which, most in ((short, sizes), (~short, {0: LONG_TEXTS, 1: LONG_TEXTS})))
    return fit(short_texts[1], short_texts[0], counts.get(1, 0) / max(1, sum(counts.values())), long_texts[1], long_texts[0])


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> CompressionModel:
    return pickle.loads(blob)


def score_column(model: CompressionModel | None, text):
    """The score of a binary text column; 0.0 for every text where there was nothing to learn from."""
    if model is None:
        return F.lit(0.0)
    blob = pickle.dumps(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = _loaded(blob)
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Every window of the whole text is compressed with both dictionaries where the row was read; no
    shuffle.  Null and empty texts are one empty window and get that window's score.  Null ids fall
    into the held-out fold.  Labels of a repeated id count as toxic if one of them does.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       score_column(model, text_bytes(text_col)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
