"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A record is: payload length (unsigned 64 bit), masked checksum of these eight bytes (32 bit), the
payload, masked checksum of the payload; all little-endian.  The checksum is CRC-32; the mask
rotates it by 15 bits and adds a constant, so that checksums of data that holds checksums stay
well spread.  The payload is the document's ids as unsigned 16-bit integers where the vocabulary
allows, else 32-bit.  Beside each file ``x.rec`` stands ``x.idx`` with one fixed-size entry per
record (offset, payload length, document id), from which records are read in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.bpe import LATIN, chunks
from shelfcast.llm.common import file_system, prepare, shared_folder, store, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Chunks of text whose ids a worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("has_id", "<u8")])
MASK = 0xA282EAD8
#: Letters alone, with the one space before them: one piece of the byte-level splitting pattern.
plain_word = re.compile(f" ?[{LATIN}]+").fullmatch


def _letters() -> dict[int, str]:
    """The space and the letters of ``LATIN`` beyond ASCII by the letters that stand for their UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x250))}


LETTERS = _letters()


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(source) -> bytes | None:
    """The next record's payload; None at the end of the file; an error if a checksum differs."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("record length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = source.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("record payload is damaged")
    return body[:size]


def read_at(folder: str, name: str, positions) -> list[tuple[int | None, bytes]]:
    """(doc_id, payload) of the records at ``positions`` of a file, by its index, in the order asked for."""
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{name}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    out = []
    with system.open_input_file(f"{path}/{name}.rec") as f:
        for p in positions:
            f.seek(int(index[p]["offset"]))
            out.append((int(index[p]["doc_id"]) if index[p]["has_id"] else None, read_frame(f)))
    return out


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library.

    The library's byte-level pre-tokenizer never joins text across the borders of ``chunks`` and
    keeps no state, so the ids of a text are those of its chunks in a row; each distinct chunk is
    encoded once as long as it is remembered.  The strings of added tokens in a text are their ids,
    as in the library's plain call: texts are cut around them first.  A chunk of letters alone is one
    piece for the pre-tokenizer, so it goes to the library's model directly, its bytes written as the
    letters that stand for them.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if self.special is None or len(parts := self.special.split(text)) == 1:
            return chunks(text)
        return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else chunks(part))]

    def fresh(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of chunks by the library."""
        kind, model, out, rest = self.kind, self.model.tokenize, {}, []
        for m in missing:
            if plain_word(m):
                word = m.replace(" ", "\u0120") if m.isascii() else m.translate(LETTERS)
                out[m] = array(kind, [t.id for t in model(word)]).tobytes()
            else:
                rest.append(m)
        for m, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[m] = array(kind, e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, cuts = self.known, self.older, [self.cut(t) for t in texts]
        found = [list(map(known.get, cut)) for cut in cuts]
        gaps = [[i for i, ids in enumerate(ids_of) if ids is None] if None in ids_of else () for ids_of in found]
        missing = {cut[i] for cut, gap in zip(cuts, gaps) for i in gap}
        again = missing & older.keys()
        fresh = {m: older[m] for m in again}
        fresh.update(self.fresh(list(missing - again)))
        for cut, ids_of, gap in zip(cuts, found, gaps):
            for i in gap:
                ids_of[i] = fresh[cut[i]]
        known.update((m, ids) for m, ids in fresh.items() if len(m) <= REMEMBERED_CHARS)
        return [b"".join(ids_of) for ids_of in found]


@lru_cache(maxsize=2)
def encoder(name: str) -> LibraryEncoder:
    return LibraryEncoder(name)


def write_records(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order; return one row per file: part, name, records, tokens.

    The ids' ranges are dealt to tasks, each of which sorts its own and writes one file under a name
    that no other attempt uses: a task that is run again leaves an orphan behind, never a damaged
    or doubled file, as only files in the returned (and stored) manifest count.  Null ids come
    first; a null text has only the end id; rows that repeat an id stand side by side.
    """
    def run(batches):
        system, path = file_system(folder)
        encode = encoder(vocabulary)
        end = np.array([end_id], encode.dtype).tobytes()
        part, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}"
        records = tokens = offset = 0
        data = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                system.create_dir(path, recursive=True)
                data, index = system.open_output_stream(f"{path}/{name}.rec"), system.open_output_stream(f"{path}/{name}.idx")
            entries = np.zeros(batch.num_rows, INDEX)
            ids = batch.column("doc_id").to_pylist()
            for i, payload in enumerate(encode.encode(batch.column("text").to_pylist())):
                payload += end
                entries[i] = offset, len(payload), ids[i] or 0, ids[i] is not None
                offset += data.write(frame(payload))
                tokens += len(payload) // encode.dtype.itemsize
            index.write(entries.tobytes())
            records += batch.num_rows
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "records": [records], "tokens": [tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return store(ordered.mapInArrow(run, "part int, name string, records bigint, tokens bigint"))


def read_records(manifest: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Read the files of a manifest back, one row per record: doc_id, start, n_tokens, ids_crc32.

    A file's first id number is the sum of the tokens of the files before it, from the manifest.
    Every checksum is verified, and every record must stand where the index says.
    """
    def run(batches):
        system, path = file_system(folder)
        width = encoder(vocabulary).dtype
        for batch in batches:
            for file in batch.to_pylist():
                with system.open_input_file(f"{path}/{file['name']}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                starts, counts, sums, start, offset = [], [], [], file["base"], 0
                with system.open_input_stream(f"{path}/{file['name']}.rec", buffer_size=1 << 20) as f:
                    while (payload := read_frame(f)) is not None:
                        at = len(starts)
                        if at >= len(index) or index[at]["offset"] != offset or index[at]["length"] != len(payload):
                            raise ValueError("the index does not match the records")
                        ids = np.frombuffer(payload, width)
                        starts.append(start)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                        offset += len(payload) + 16
                if len(starts) != file["records"]:
                    raise ValueError("records are missing")
                doc_id = pa.array(index["doc_id"], mask=index["has_id"] == 0)
                for i in range(0, len(starts), 10_000):
                    n = min(10_000, len(starts) - i)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": doc_id.slice(i, n), "start": pa.array(starts[i:i + n], pa.int64()),
                        "n_tokens": pa.array(counts[i:i + n], pa.int64()), "ids_crc32": pa.array(sums[i:i + n], pa.int64())})

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_records(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = shared_folder(spark, "records")
    return read_records(write_records(table(spark, sf_dir, "documents"), folder), folder)
