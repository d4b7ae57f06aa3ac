"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

Each document's shingle set has a sketch of ``SKETCH`` minwise tokens.  In a tree, a node selects
tokens (position, value) at random and sends each of its documents to one child per selected token
that the document has.  Two documents of the threshold's similarity then share
``SHARED_CHILDREN`` children on average, less similar ones fewer, so nodes shrink to groups of similar documents.  Nodes of at most ``NODE_LIMIT`` documents
are compared exhaustively; larger ones branch again.  Independent trees repeat this.

All nodes of one depth are handled together, as rows (node, document): a node's size is a map-side
combined count, and no task ever holds a node of more than ``NODE_LIMIT`` documents.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import (WordHashes, components, groups, mix64, prepare, store, table, text_bytes,
                                  window_hashes)

SHINGLE, QUERY_SHINGLE = 5, 4
THRESHOLD_PERCENT = 80
SKETCH = 64
#: Passes as (trees, depth).  A pass skips nodes whose documents earlier ones have joined into one
#: component; the first ones find the groups of very many near copies, which no depth would split.
PASSES = ((2, 1), (4, 1), (14, 3))
#: Children that two documents of the threshold's similarity share on average.  Above 1, such a
#: pair stays together to any depth in most trees: at depth 3 with probability 0.52, in one of 14
#: trees but for 3 in 100,000.
SHARED_CHILDREN = 1.25
NODE_LIMIT = 128
#: Rows of ids up to which they are broadcast, so that only the other side's rows travel, if any.
BROADCAST_IDS = 1_000_000
#: Pairs whose sketches agree in fewer positions are not compared on their sets: five standard
#: deviations below the threshold (0.8 of 64 positions, deviation 3.2), a loss of 1.2 in a million.
LEAST_AGREEING = 35
#: One-bit minwise values of documents in nodes that do not split, and their least agreement: at the
#: threshold a bit agrees with probability 0.9, so that 4 pairs in ten million are missed.
WIDE, LEAST_WIDE = 1024, 872
#: Documents and shingles of a block of such a node.
BLOCK, BLOCK_ITEMS = 4096, 2_000_000
#: Units that share documents are confirmed as one group up to so many documents (and ``BLOCK_ITEMS``
#: shingles), found by so many rounds of passing on the smallest document.
GROUP_LIMIT, ROUNDS = 512, 2
#: Shingles that are looked up in one set at once.
LOOKUP_ITEMS = 1 << 18
FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_SEEDS = mix64(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64))
_MULTIPLY, _ADD = _SEEDS[:SKETCH] | np.uint64(1), _SEEDS[SKETCH:]
_WIDE = mix64(np.arange(1000, 1000 + WIDE, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle of their own length."""
    words = known.array(text.translate(FOLD).split())
    if not len(words):
        return words
    if len(words) < k:
        return window_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(window_hashes(words, k))


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def text_key(name: str = "text"):
    """Tells the texts of one id apart."""
    return F.xxhash64(text_bytes(name))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``SKETCH`` minwise 32-bit tokens for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SKETCH), np.uint32)
    for i in range(SKETCH):
        out[:, i] = np.minimum.reduceat(((flat * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set and sketch, one row per input row."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, k, known) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(sketches(full)) if full else iter(())
            digests = [set_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), text_key(text_col).alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, sketch binary")


def branch(frame: DataFrame) -> DataFrame:
    """(node, cls, comp, sketch) -> (node, cls, comp): each document's children of the node."""

    def run(batches):
        chance = np.uint64(int(2.0 ** 64 * SHARED_CHILDREN * 100 / (THRESHOLD_PERCENT * SKETCH)))
        position = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
            node = batch.column("node").to_numpy().view(np.uint64)
            token = mix64(position[None, :] + sketch.astype(np.uint64))
            row, at = np.nonzero(mix64(node[:, None] ^ token) < chance)
            child = mix64(node[row] * np.uint64(3) + token[row, at])
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("cls").take(row), batch.column("comp").take(row)], ["node", "cls", "comp"])

    return frame.select("node", "cls", "comp", "sketch").mapInArrow(run, "node bigint, cls bigint, comp bigint")


def by_node(frame: DataFrame, key: str) -> DataFrame:
    return frame.repartition(key).sortWithinPartitions(key)


class Forest:
    """Union of positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def similar_units(frame: DataFrame) -> DataFrame:
    """(node, cls, comp, sketch, n) -> distinct (unit, cls, comp, n).

    Compares all documents of a node by their sketches, but for pairs that are in one component
    already; each connected part of what may be similar becomes a unit.  A unit is named by its
    members, so the same documents met in many nodes and trees make one unit.
    """

    def run(batches):
        for group in groups(batches, "node"):
            if group.num_rows < 2:
                continue
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
            cls, comp, size = (group.column(c).to_numpy() for c in ("cls", "comp", "n"))
            forest, hit = Forest(len(cls)), False
            for i in range(len(cls) - 1):
                agreeing = np.count_nonzero(sketch[i + 1:] == sketch[i], axis=1)
                least, most = np.minimum(size[i + 1:], size[i]), np.maximum(size[i + 1:], size[i])
                near = (agreeing >= LEAST_AGREEING) & (100 * least >= THRESHOLD_PERCENT * most)
                for j in np.flatnonzero(near & (comp[i + 1:] != comp[i])).tolist():
                    hit |= forest.join(i, i + 1 + j)
            if not hit:
                continue
            root = np.array([forest.find(i) for i in range(len(cls))])
            for r in np.unique(root[root != np.arange(len(cls))]):
                members, at = np.unique(cls[root == r], return_index=True)
                unit = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), unit)), pa.array(members), pa.array(comp[root == r][at]), pa.array(size[root == r][at])],
                                                 ["unit", "cls", "comp", "n"])

    return by_node(frame.select("node", "cls", "comp", "sketch", "n"), "node").mapInArrow(
        run, "unit bigint, cls bigint, comp bigint, n bigint").repartition("unit").distinct()


def unseen_units(units: DataFrame, seen: DataFrame) -> DataFrame:
    """The units but for those whose documents were all confirmed in one group (cls, seen) before."""
    unit = Window.partitionBy("unit")
    marks = units.join(seen, "cls", "left").withColumns({
        "all": F.count(F.lit(1)).over(unit), "marked": F.count("seen").over(unit), "lo": F.min("seen").over(unit), "hi": F.max("seen").over(unit)})
    return marks.where("marked < all OR lo <> hi").select(units.columns)


def merged_units(units: DataFrame, mark: int) -> tuple[DataFrame, DataFrame]:
    """(unit, cls, comp) with units that share documents merged, and (cls, seen): the merged ones.

    All pairs of a unit are compared, so a group of units stands for all of them and each of its
    documents travels once.  A group above the limits, or a unit that the rounds have not brought
    into one group, stays as it is.  ``mark`` tells the groups of different calls apart.
    """
    label = units.withColumn("label", F.col("cls"))
    for _ in range(ROUNDS):
        for key in ("unit", "cls"):
            label = label.withColumn("label", F.min("label").over(Window.partitionBy(key)))
    unit = Window.partitionBy("unit")
    label = store(label.withColumn("whole", F.min("label").over(unit) == F.max("label").over(unit)))
    groups = label.groupBy("label", "cls").agg(F.min("comp").alias("comp"), F.min("n").alias("n"), F.max("whole").alias("whole"))
    small = few(store(groups.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"), F.max("whole").alias("whole")).where(
        (F.col("m") <= GROUP_LIMIT) & (F.col("items") <= BLOCK_ITEMS) & F.col("whole")).select("label", "whole")))
    merged = groups.join(small.select("label"), "label").select(F.xxhash64("label", F.lit(mark)).alias("unit"), "cls", "comp", F.lit(True).alias("merged"))
    rest = label.join(small, ["label", "whole"], "left_anti").select("unit", "cls", "comp", F.lit(False).alias("merged"))
    found = store(merged.unionByName(rest))
    return found.select("unit", "cls", "comp"), found.where("merged").select("cls", F.col("unit").alias("seen"))


def similar_pairs(frame: DataFrame) -> DataFrame:
    """(pair, node, cls, comp, odd, own, other, n, wide, nodes) -> (pair, cls, comp, partners), of nodes that do not split.

    Documents of the block marked ``own`` are compared with those marked ``other`` by their bits.  A
    pair met in several nodes counts in the smallest of them.  A row with ``partners`` lists a
    document's partners; each document of a listed pair has one row without.
    """

    def run(batches):
        for group in groups(batches, "pair"):
            cls, comp, size, odd, own, other = (group.column(c).to_numpy() for c in ("cls", "comp", "n", "odd", "own", "other"))
            bits = np.frombuffer(b"".join(group.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            pair, node = group.column("pair")[0].as_py(), group.column("node")[0].as_py()
            earlier = [{x for x in nodes if x < node} for nodes in group.column("nodes").to_pylist()]
            others, found, met = np.flatnonzero(other), [], set()
            for i in np.flatnonzero(own).tolist():
                n = size[others]
                j = others[(comp[others] != comp[i]) & (~odd[others] | (cls[others] > cls[i]))
                           & (100 * np.minimum(n, size[i]) >= THRESHOLD_PERCENT * np.maximum(n, size[i]))]
                j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= WIDE - LEAST_WIDE].tolist()
                j = [x for x in j if earlier[i].isdisjoint(earlier[x])]
                if j:
                    found.append((cls[i], comp[i], cls[j].tobytes()))
                    met.update(j, [i])
            found += [(cls[i], comp[i], None) for i in met]
            if found:
                c, p, partners = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([pair] * len(c), pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.int64()),
                                                  pa.array(partners, pa.binary())], ["pair", "cls", "comp", "partners"])

    return by_node(frame, "pair").mapInArrow(run, "pair bigint, cls bigint, comp bigint, partners binary")


def confirmed_pairs(found: DataFrame, classes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the links among the pairs of ``similar_pairs``, confirmed on the full shingle sets.

    A task holds the sets of two blocks at most.  Pairs that confirmed links of the same blocks
    already connect are not compared.
    """
    met = found.where("partners IS NULL").select("pair", "cls", "comp")
    items = class_sets(met, classes, docs, k, id_col, text_col, np.ndarray.tobytes)
    rows = (met.join(items, "cls").select("pair", "cls", "comp", "items", F.lit(None).cast("binary").alias("partners"))
            .unionByName(found.where("partners IS NOT NULL").withColumn("items", F.lit(None).cast("binary"))))

    def confirm(batches):
        for group in groups(batches, "pair"):
            sets, lists, first, at = {}, [], {}, {}
            for c, p, x, partners in zip(*(group.column(n).to_pylist() for n in ("cls", "comp", "items", "partners"))):
                if partners is not None:
                    lists.append((c, np.frombuffer(partners, np.int64).tolist()))
                elif c not in sets:
                    sets[c] = np.frombuffer(x, np.uint64)
                    at[c] = first.setdefault(p, len(first))
            forest, out = Forest(len(first)), []
            for a, partners in lists:
                x = sets[a]
                step = max(1, LOOKUP_ITEMS // (2 * len(x)))  # a partner has at most 1.25 times the shingles
                for s in range(0, len(partners), step):
                    todo = [b for b in partners[s:s + step] if forest.find(at[a]) != forest.find(at[b])]
                    if not todo:
                        continue
                    sizes = np.array([len(sets[b]) for b in todo])
                    flat = np.concatenate([sets[b] for b in todo])
                    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
                    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                    for i in np.flatnonzero(100 * both >= THRESHOLD_PERCENT * (len(x) + sizes - both)).tolist():
                        if forest.join(at[a], at[todo[i]]):
                            out.append((a, todo[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out)], ["a", "b"])

    return by_node(rows, "pair").mapInArrow(confirm, "a bigint, b bigint")


def class_sets(named: DataFrame, classes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str, make, along: str | None = None) -> DataFrame:
    """(cls, items): ``make`` of the full shingle set, for the classes in ``named``.

    With ``along``, a column of 64-bit numbers, (cls, along, items): a row for each of a class's
    numbers, so that the sets travel once, straight to where they are grouped by them.

    Only texts of their documents travel: the ids are broadcast if there are few of them (they are
    counted first), else the texts are joined by a shuffle.  Where rows repeat an id with other
    texts, the digest tells which text is the class's.
    """
    named = named.groupBy("cls").agg(F.collect_set(along).alias("along")) if along else named.select("cls", F.array().cast("array<bigint>").alias("along")).distinct()
    wanted = few(store(named.join(classes.select("cls", "rep", "digest"), "cls")))

    def sets(batches):
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, k, known) for t in batch.column("text").to_pylist()]
            own = [set_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist())]
            found = [make(s) for s, o in zip(sets, own) if o]
            own = pa.array(own, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("cls").filter(own), batch.column("along").filter(own), pa.array(found, pa.binary())], ["cls", "along", "items"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_bytes(text_col).alias("text")).join(wanted, "rep").select("cls", "along", "digest", "text")
    items = texts.mapInArrow(sets, "cls bigint, along array<bigint>, items binary")
    return items.select("cls", F.explode("along").alias(along), "items") if along else items.select("cls", "items")


def wide_sketch(items: np.ndarray) -> bytes:
    """One bit of each of ``WIDE`` minwise values."""
    least = np.full(WIDE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):
        np.minimum(least, (items[at:at + 256, None] * _WIDE).min(axis=0), out=least)
    return np.packbits((least >> np.uint64(24)).astype(np.uint8) & 1).tobytes()


def exact_links(units: DataFrame, classes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links that join the classes of each unit, confirmed on the full shingle sets.

    Within a unit, a pair that confirmed links already connect is not compared again, so a unit
    of n components gives n - 1 links at most.
    """
    items = class_sets(units, classes, docs, k, id_col, text_col, np.ndarray.tobytes, "unit")
    comps = units.select("unit", "cls", "comp", F.lit(None).cast("binary").alias("items"))
    rows = items.select("unit", "cls", F.lit(None).cast("long").alias("comp"), "items").unionByName(comps)

    def confirm(batches):
        for group in groups(batches, "unit"):
            at, comp = {}, {}
            for c, p, x in zip(*(group.column(n).to_pylist() for n in ("cls", "comp", "items"))):
                if x is None:
                    comp[c] = p
                else:
                    at.setdefault(c, np.frombuffer(x, np.uint64))
            cls = sorted(at, key=lambda c: (-len(at[c]), c))
            forest, out, first = Forest(len(cls)), [], {}
            for i, c in enumerate(cls):
                forest.join(first.setdefault(comp[c], i), i)
            for i, a in enumerate(cls):
                for j in range(i + 1, len(cls)):
                    x, y = at[a], at[cls[j]]
                    if 100 * len(y) < THRESHOLD_PERCENT * len(x):
                        break  # they come by falling size
                    if forest.find(i) == forest.find(j):
                        continue
                    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                    if 100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both):
                        forest.join(i, j)
                        out.append((a, cls[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out)], ["a", "b"])

    return by_node(rows, "unit").mapInArrow(confirm, "a bigint, b bigint")


def few(ids: DataFrame) -> DataFrame:
    """A stored frame of ids, broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def with_component(frame: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return frame.withColumn("comp", F.col("cls"))
    return frame.join(few(comps), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def tree_nodes(sketch: DataFrame, seeds: range, max_depth: int, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Nodes of (cls, comp, sketch) to compare, as (node, cls, comp) frames, and those still above ``limit`` at the last depth."""
    roots = F.array(*[F.lit(int(s)) for s in mix64(np.array(seeds, np.uint64)).view(np.int64)])
    frame = sketch.withColumn("node", F.explode(roots))
    compare = []
    for _ in range(max_depth):
        level = store(branch(frame))
        # nodes of one component have nothing left to find
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("size > 1 AND lo <> hi")
        level = store(level.join(sizes.select("node", "size"), "node"))
        compare.append(level.where(F.col("size") <= limit).select("node", "cls", "comp"))
        large = level.where(F.col("size") > limit)
        if large.isEmpty():
            return compare, None
        frame = large.select("node", "cls").join(sketch, "cls")
    return compare, large


def in_chunks(large: DataFrame, limit: int) -> DataFrame:
    """Nodes that do not split: chunks of about ``limit`` documents, each with the node's first document."""
    chunks = F.ceil(F.col("size") / F.lit(limit))
    first = large.groupBy("node", "size").agg(F.min_by(F.struct("cls", "comp"), F.xxhash64("cls")).alias("f"))
    first = first.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    first = first.select(F.xxhash64("node", "chunk").alias("node"), "f.cls", "f.comp")
    return large.select(F.xxhash64("node", F.pmod(F.xxhash64("cls", F.lit(7)), chunks)).alias("node"), "cls", "comp").unionByName(first).distinct()


def across_blocks(rest: DataFrame, block: int) -> DataFrame:
    """(node, cls, comp, n) of nodes that do not split -> every pair of different components, block by block.

    The node's largest component is not compared with itself: each block that has other documents,
    marked ``odd``, meets every block of the node, so all pairs that could still join two
    components are compared.  Rows of a pair of blocks share ``pair``; ``own`` marks the odd
    documents of the first block and ``other`` all documents of the second.
    """
    counts = rest.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
    blocks = F.ceil(F.greatest(F.sum("m") / F.lit(block), F.sum("items") / F.lit(BLOCK_ITEMS)))
    nodes = counts.groupBy("node").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), blocks.alias("blocks"))
    rows = store(rest.join(nodes, "node").select(
        "node", "cls", "comp", "n", "blocks", F.pmod(F.xxhash64("cls", F.lit(11)), "blocks").alias("block"), (F.col("comp") != F.col("main")).alias("odd")))
    first = rows.where("odd").select("node", F.col("block").alias("first")).distinct()
    pair = F.xxhash64("node", "first", "block").alias("pair")
    same = (F.col("first") == F.col("block")) & F.col("odd")
    second = rows.join(first, "node").select(pair, "node", "cls", "comp", "n", "odd", same.alias("own"), F.lit(True).alias("other"))
    rows = rows.where("odd AND blocks > 1").withColumnRenamed("block", "first").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return second.unionByName(rows.where("block <> first").select(pair, "node", "cls", "comp", "n", "odd", F.lit(True).alias("own"), F.lit(False).alias("other")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                    limit: int = NODE_LIMIT, passes: tuple[tuple[int, int], ...] = PASSES,
                    keyed: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; if ``keyed``, text_key too.

    Words are runs of characters other than space and control white space, A-Z lower-cased.  Texts
    with equal shingle sets are one class, so copies are joined once and never paired.  Classes go
    through the trees; candidate pairs are confirmed on full sets (100 * intersection >= 80 *
    union); components are those of the confirmed links.

    Texts without words, null texts and null ids link with nothing; a null id has a null component
    and is kept.  Rows that repeat an id and text share the component and are marked alike.
    """
    prepare(docs.sparkSession)
    rows = store(signatures(docs, k, id_col, text_col).withColumn(
        "cls", F.when(F.col("doc_id").isNotNull(), F.xxhash64("digest"))).withColumn("cls", F.when(F.col("digest").isNotNull(), F.col("cls"))))
    classes = store(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("digest").alias("digest"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n")))
    comps, seen, done = None, None, 0
    for n, depth in passes:
        rest = None
        named = with_component(classes.select("cls", "sketch", "n"), comps)
        named = named if comps is None else store(named)  # read once for every depth
        compare, large = tree_nodes(named, range(done + 1, done + n + 1), depth, limit)
        done += n
        if large is not None:
            compare.append(in_chunks(large, limit))
            rest = large.select("node", "cls")
        comps, seen = join_up(compare, classes, docs, k, id_col, text_col, comps, seen, done)
    if rest is not None:
        rest = store(with_component(rest, comps))
        mixed = rest.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
        rest = store(rest.join(mixed, "node").join(classes.select("cls", "n"), "cls"))
        if not rest.isEmpty():
            nodes = rest.groupBy("cls").agg(F.collect_set("node").alias("nodes"))
            wide = store(class_sets(rest, classes, docs, k, id_col, text_col, wide_sketch).dropDuplicates(["cls"])
                         .select("cls", F.col("items").alias("wide")).join(nodes, "cls"))
            pairs = store(similar_pairs(across_blocks(rest, block).join(wide, "cls")))
            comps = joined(confirmed_pairs(pairs, classes, docs, k, id_col, text_col), comps)
    named = with_component(classes.select("cls", "rep"), comps)
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(names.hint("merge"), "comp").select("cls", "component_id")
    key = ["text_key"] if keyed else []
    return (rows.select("doc_id", "n_shingles", "cls", *key).join(named.hint("merge"), "cls", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *key)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def join_up(compare, classes, docs, k, id_col, text_col, comps, seen, mark):
    """The components so far with the links of the nodes in ``compare``, and the groups confirmed so far."""
    frame = compare[0]
    for part in compare[1:]:
        frame = frame.unionByName(part)
    units = similar_units(frame.join(classes.select("cls", "sketch", "n"), "cls"))
    units, groups = merged_units(units if seen is None else unseen_units(units, few(seen)), mark)
    if seen is not None:  # a document counts in its last group
        groups = store(groups.unionByName(seen.join(few(groups.select("cls")), "cls", "left_anti")))
    return joined(exact_links(units, classes, docs, k, id_col, text_col), comps), groups


def joined(new, comps):
    """(cls, comp): the components so far and new links (a, b) as one."""
    links = new if comps is None else new.unionByName(comps.select(F.col("cls").alias("a"), F.col("comp").alias("b")))
    return store(components(links, "a", "b").toDF("cls", "comp"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), QUERY_SHINGLE)
