"""Source divergence audit: how far the term shares of each source lie from those of its language and of the other sources."""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import prepare, store, table, text_bytes

MIN_DOCS = 10
TOP = 10
SCALE = 10 ** 9
#: Distinct (group, term) pairs a task counts before it hands them on.
HELD_TERMS = 500_000
#: Shares (sources x terms) in the table of one block of terms.
BLOCK_CELLS = 1 << 16
#: Rows of a group that a task holds before it reduces them to their skyband.
HELD_ROWS = 50_000
#: Parts of a group in the first merge of skybands.
MERGE_PARTS = 16

#: Bytes of terms (ASCII letters, folded, and all bytes of other characters); every other byte parts terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) per group and term, and a row with a null term for each group."""

    def count(batches):
        held = {}
        size = 0

        def flush():
            for (lang, source), (n, docs_of) in held.items():
                terms = list(n)
                yield pa.record_batch({
                    "lang": pa.array([lang] * (len(terms) + 1), pa.string()), "source": pa.array([source] * (len(terms) + 1), pa.string()),
                    "term": pa.array([None, *terms], pa.binary()), "n": pa.array([0, *n.values()], pa.int64()),
                    "docs": pa.array([0, *map(docs_of.__getitem__, terms)], pa.int64())})
            held.clear()

        for batch in batches:
            langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
            for i, key in enumerate(zip(langs, sources)):
                terms = texts[i].as_py().translate(_TERM_BYTES).split()
                size += key not in held
                n, docs_of = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                docs_of.update(set(terms))
                size += len(n)
                if size > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), text_bytes(text_col).alias("text"))
    parts = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str):
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) in whole numbers; ``kept`` must not be 0."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({count} + 2 AS decimal(19,0))) div cast({total} + 2 * {kept} AS decimal(19,0))")


# ------------------------------------------------------------------ term part: skybands

def skyband(terms: list, n: np.ndarray, lang_n: np.ndarray, k: int) -> np.ndarray:
    """Positions of the terms that fewer than ``k`` others dominate.

    A term dominates another with a count not below, a language count not above and an earlier
    place in UTF-8 order.  All dominators stand before their term in the order (count descending,
    language count, term), and the first ``k`` of them are in the skyband themselves, so it is
    enough to count dominators among those kept so far.
    """
    place = np.empty(len(terms), np.int64)
    place[pc.sort_indices(pa.array(terms, pa.binary())).to_numpy()] = np.arange(len(terms))
    order = np.lexsort((place, lang_n, -n))
    l, p = lang_n[order], place[order]
    kept = []
    kept_l, kept_p = np.empty(0, np.int64), np.empty(0, np.int64)
    for a in range(0, len(order), 256):
        bl, bp = l[a:a + 256], p[a:a + 256]
        above = ((kept_l <= bl[:, None]) & (kept_p < bp[:, None])).sum(1)
        fresh = []
        for i in np.flatnonzero(above < k).tolist():
            if above[i] + sum(bl[j] <= bl[i] and bp[j] < bp[i] for j in fresh) < k:
                fresh.append(i)
        kept += [a + i for i in fresh]
        kept_l, kept_p = np.concatenate([kept_l, bl[fresh]]), np.concatenate([kept_p, bp[fresh]])
    return order[kept]


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of every (lang, source) inside each partition of (lang, source, term, n, lang_n)."""
    columns = ["term", "n", "lang_n"]

    def reduce(parts):
        t = pa.concat_tables(parts)
        at = skyband(t.column("term").to_pylist(), t.column("n").to_numpy(), t.column("lang_n").to_numpy(), k)
        return t.take(pa.array(at))

    def bands(batches):
        held, limit = {}, {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lang, source in set(zip(t.column("lang").to_pylist(), t.column("source").to_pylist())):
                key = (lang, source)
                rows = t.filter(pc.and_(pc.equal(t.column("lang"), lang), pc.equal(t.column("source"), source))).select(columns)
                held.setdefault(key, []).append(rows)
                if sum(x.num_rows for x in held[key]) > limit.get(key, HELD_ROWS):
                    held[key] = [reduce(held[key])]
                    limit[key] = max(HELD_ROWS, 2 * held[key][0].num_rows)
        for (lang, source), parts in held.items():
            t = reduce(parts)
            t = t.add_column(0, "lang", pa.array([lang] * t.num_rows, pa.string())).add_column(1, "source", pa.array([source] * t.num_rows, pa.string()))
            yield from t.to_batches()

    kind = "lang string, source string, term binary, n long, lang_n long"
    return rows.select("lang", "source", F.col("term").cast("binary").alias("term"), "n", "lang_n").mapInArrow(bands, kind)


def far_terms(kept: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): per group the ``top`` terms of greatest divergence from their language.

    With the group's share above the language's, the divergence does not fall with the group's
    count nor rise with the language's, and ties go to the earlier term: a term that ``top`` others
    dominate is in no report.  Partitions keep their skybands; these are merged, by parts of a
    group and then whole, and only what is left is ranked by exact values.
    """
    p, q = share("n", "group_total", "kept"), share("lang_n", "lang_total", "kept")
    rows = kept.join(sizes.where("kept > 0"), ["lang", "source"]).where(p > q).select("lang", "source", "term", "n", "lang_n")
    bands = skybands(rows, top)
    bands = skybands(bands.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE_PARTS))), top)
    bands = skybands(bands.repartition("lang", "source"), top)
    scored = bands.withColumn("item", F.col("term").cast("string")).join(sizes, ["lang", "source"]).withColumn("p", p).withColumn("q", q)
    scored = scored.withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return scored.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


# ------------------------------------------------------------------ pair part: blocks of terms

def pair_sums(batches):
    """Sums over the terms of a block, per unordered pair of sources, of the divergence of their shares.

    A block's rows with an empty ``term`` hold a source's share of a term it does not have.  ``a`` is
    the earlier source of a pair in every block, whatever order the rows come in.
    """
    t = pa.Table.from_batches(list(batches))
    lang, terms, shares = t.column("lang")[0].as_py(), t.column("term").combine_chunks(), t.column("p").to_numpy()
    is_source = pc.is_null(terms).to_numpy(zero_copy_only=False)
    sources = pc.unique(t.column("source")).sort()
    names, at = sources.to_pylist(), pc.index_in(t.column("source"), value_set=sources).to_numpy()
    column = terms.filter(pa.array(~is_source)).dictionary_encode()
    grid = np.zeros((len(names), len(column.dictionary)), np.int64)
    grid[at[is_source]] = shares[is_source][:, None]
    grid[at[~is_source], column.indices.to_numpy()] = shares[~is_source]
    for i in range(len(names) - 1):
        apart = grid[i + 1:] - grid[i]
        value = (apart * apart // np.maximum(grid[i + 1:] + grid[i], 1)).sum(1)
        n = len(names) - 1 - i
        yield pa.record_batch({"lang": pa.array([lang] * n, pa.string()), "a": pa.array([names[i]] * n, pa.string()),
                               "b": pa.array(names[i + 1:], pa.string()), "value": pa.array(value, pa.int64())})


def far_sources(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): per group its divergence from every other source of the language.

    The terms of a language are dealt into blocks of about ``BLOCK_CELLS`` shares; each block also
    gets one row per source with the share of an absent term.  A block yields one partial sum per
    unordered pair of sources, which is summed on the map side first.
    """
    blocks = sizes.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.first("kept") * F.count(F.lit(1)) / BLOCK_CELLS)).cast("int").alias("blocks"))
    sizes = sizes.join(blocks, "lang")
    p = F.when(F.col("kept") > 0, share("n", "group_total", "kept"))
    rows = kept.join(sizes, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", p.alias("p"))
    absent = sizes.withColumn("n", F.lit(0)).select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
                                                    F.lit(None).cast("string").alias("term"), F.coalesce(p, F.lit(1)).alias("p"))
    sums = rows.unionByName(absent).groupBy("lang", "block").applyInArrow(_pair_table, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    out = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order))


def _pair_table(t: pa.Table) -> pa.Table:
    kind = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
    return pa.Table.from_batches(pair_sums(t.to_batches()), kind)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part ``pair`` ranks the other sources of the language, part ``term`` the ``top`` terms that the
    group uses more than its language does.  Null lang, source and text count as empty; every row
    is a document of its own, also one that repeats; a group without terms still has its pairs; an
    empty table has no rows.  Columns other than the three are not read.  Shares and values are
    whole numbers throughout.
    """
    prepare(docs.sparkSession)
    counts = store(count_terms(docs, lang_col, source_col, text_col))
    terms = (counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("__docs"))
             .where(F.col("__docs") >= min_docs).drop("__docs"))
    kept = store(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    groups = counts.where("term IS NULL").select("lang", "source")
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    # a term's language count stands in each of its rows: a row weighs one in the number of its sources
    in_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sizes = store(groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
                  .select("lang", "source", zero("group_total"), zero("kept"), zero("lang_total")))
    pairs = far_sources(kept, sizes).withColumn("part", F.lit("pair"))
    far = far_terms(kept, sizes, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(far).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
o AS (SELECT id, lang, source, translate(unnest(words), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
s AS (SELECT c.lang, c.source, sum(n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.lang_n + 2) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 10
"""
