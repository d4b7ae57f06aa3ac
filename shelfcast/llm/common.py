"""Helpers shared by the operators: shared-folder tables, word hashes, prefix sums, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.session import ensure_checkpoint_dir

#: Arrow batches handed to Python: few rows, and few bytes where texts are long.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that very long texts do not pile up in a Python worker."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Cuts the lineage; the copy survives lost executors and is read with column pruning.
    """
    path = shared_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(name: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


# ------------------------------------------------------------------ hashing in tasks

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply rounds)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the most part of a task; size is bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base of word hashes, and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def hash_words(text: bytes, segment: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text and where each begins and ends, without a Python object per word.

    A word's hash is that of a polynomial in its bytes, taken as a difference of prefix sums.
    """
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACES[data], [True]])))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + segment, "right")))
        n = int(ends[j - 1] - at)
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at:at + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        hashes[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix64(hashes), starts, ends


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of every run of ``k`` consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += hashes[i:i + n]
    return mix64(acc)


def groups(batches, key: str):
    """Runs of rows of equal key, as tables, from batches that are sorted by it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


# ------------------------------------------------------------------ files in the shared folder

def file_system(uri: str):
    """The Arrow file system of a folder's address, and the folder's path on it."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------------ prefix sums without one task per group

def blocked_prefix(df: DataFrame, group: list[str], block: str, order: list[str], value, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that stand before this row.

    Rows stand in the order (``block``, ``order``).  Only a (group, block) pair is ever sorted in
    one task; the groups' running totals are taken over one row per block.  ``group`` and ``block``
    must not be null, and ``df`` is read twice.
    """
    keys = [*group, block]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(offsets.hint("merge"), keys)
            .withColumn(out, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("__offset"))


# ------------------------------------------------------------------ connected components

#: Edges that one task joins in its memory, about 16 bytes and two nodes each.
EDGES_IN_TASK = 200_000


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v): every node with the smallest node that its task's edges connect it with, itself if it is that one.

    A task takes ``EDGES_IN_TASK`` edges at a time.
    """
    limit = EDGES_IN_TASK

    def joined(batches):
        edges = pa.Table.from_batches(batches)
        nodes, at = np.unique(np.concatenate([edges.column("u").to_numpy(), edges.column("v").to_numpy()]), return_inverse=True)
        up, n = list(range(len(nodes))), edges.num_rows
        for a, b in zip(at[:n].tolist(), at[n:].tolist()):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[max(a, b)] = min(a, b)
        for i, x in enumerate(up):
            up[i] = up[x]  # x is i or comes before it
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], ["u", "v"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if held and rows + batch.num_rows > limit:
                yield joined(held)
                held, rows = [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield joined(held)

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node.

    Edges that fit one task (``EDGES_IN_TASK``) are joined there.  Of more, each task joins its own
    first; then the large-star and small-star steps alternate until the edge set no longer changes:
    each node's smallest neighbour comes from a map-side combined aggregate and is joined back, so a
    node of very many edges is neither collected nor held in one task.
    """
    cur = store(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    tasks = -(-cur.count() // EDGES_IN_TASK)
    near = stars(cur.coalesce(max(1, tasks)))
    if tasks <= 1:
        return near.toDF("node", "component")
    cur = store(near.where("u <> v").distinct())
    seen = None
    while True:
        mark = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        # large star: each neighbour greater than the node goes to the smallest of the neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = store(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                    .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
