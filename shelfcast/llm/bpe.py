"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import prepare, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers, and the longest of them in characters.
REMEMBERED = 250_000
REMEMBERED_CHARS = 64


class RankQueue:
    """A priority queue of (rank, position): a bitmap of the non-empty ranks in two levels.

    ``top`` has a bit for each word of ``words`` that is not zero, a word a bit for each of its
    ``1 << BITS`` ranks that holds positions; two find-first-sets give the smallest rank.  A rank's
    positions are a small heap, as equal pairs must be merged from the left.  Entries are not
    removed when a merge makes them stale: whoever pops an entry checks it.
    """

    BITS = 8

    def __init__(self, ranks: int):
        self.top = 0
        self.words = [0] * ((ranks >> self.BITS) + 1)
        self.positions: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.positions.get(rank)
        if held:
            heappush(held, position)
            return
        self.positions[rank] = [position]
        word = rank >> 8
        self.top |= 1 << word
        self.words[word] |= 1 << (rank & 255)

    def pop(self) -> tuple[int, int]:
        """The leftmost position of the smallest rank; (-1, -1) when empty."""
        top = self.top
        if not top:
            return -1, -1
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = (word << 8) | (low.bit_length() - 1)
        held = self.positions[rank]
        if len(held) > 1:
            return rank, heappop(held)
        del self.positions[rank]
        bits ^= low
        self.words[word] = bits
        if not bits:
            self.top = top & (top - 1)
        return rank, held[0]


#: The white space of Unicode, as ``\s`` of the splitting pattern has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters, of which the splitting pattern makes one piece when such a character follows.
LATIN, AFTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?)"
#: Cuts a text where the splitting pattern always does: a Latin word before a space or one of
#: ``AFTER``, another run of characters with the one space before it, or white space up to there.
#: The pattern never joins characters across these borders, nor looks beyond them.
chunks = re.compile(f" ?[{LATIN}]+(?=[{AFTER}{SPACE}]|$(?!\n))| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


class Remembered(dict):
    """Results of ``make`` by text, for short texts.

    When full, all but what is asked for again is forgotten by and by: the full half becomes the
    older one, from which results move to the newer when they are met.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class BytePairCodec:
    """Encodes by merge ranks, one pre-token at a time, and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(len(self.tokens))
        self.piece_ids = Remembered(lambda piece: pack("<%dI" % len(ids := self.merge(piece.encode())), *ids))
        self.chunk_ids = Remembered(lambda chunk: b"".join(map(self.piece_ids.__getitem__, self.split(chunk))))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged, from the left, until none is left.

        The pieces are a linked list over their start positions; every merge looks up the ranks of
        its two new neighbours, so a pre-token of n bytes costs O(n) queue steps.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        queue = self.queue  # empty between calls
        end = list(range(1, n + 1))  # of the piece that starts here
        before = list(range(-1, n - 1))
        pair = [-1] * n  # the rank that the piece starting here has with its right neighbour
        for i in range(n - 1):
            r = ranks.get(piece[i:i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        push, pop = queue.push, queue.pop
        while True:
            rank, at = pop()
            if rank < 0:
                break
            if pair[at] != rank:
                continue
            right = end[at]
            stop = end[right]
            end[at] = stop
            pair[right] = -1
            pair[at] = -1
            if stop < n:
                before[stop] = at
                r = ranks.get(piece[at:end[stop]])
                if r is not None:
                    pair[at] = r
                    push(r, at)
            left = before[at]
            if left >= 0:
                r = ranks.get(piece[left:stop])
                pair[left] = -1 if r is None else r
                if r is not None:
                    push(r, left)
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at:end[at]]])
            at = end[at]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        The text is first cut where the pattern always cuts it, see ``chunks``; the pattern then
        splits each chunk into its matches.
        """
        return b"".join(map(self.chunk_ids.__getitem__, chunks(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(name: str) -> BytePairCodec:
    """The codec of a vocabulary of the tokenizers package, made once per Python worker."""
    import public_tokenizers
    return BytePairCodec(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (binary).

    The digest of the decoded bytes is taken from the ids, decoded again, not from the text.  A null
    text is empty (0 tokens); repeated rows and null ids pass through.  No shuffle: each row is
    encoded where it was read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        bpe = codec(vocabulary)
        for batch in batches:
            ids = [bpe.encode(text) for text in batch.column("text").to_pylist()]
            out = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                   pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                   pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
