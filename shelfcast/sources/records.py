"""CSV records whose quoted fields may hold line breaks, from files that are read in splits.

A line of a split may begin inside a quoted field, and only the lines before it can tell.  A
first pass maps every split to what it does to that state (begin outside or inside, end outside
or inside); composed over a file's splits, this gives the state at each split's beginning.  A
second pass joins lines to records.  What a split has of records that it does not hold whole goes
out as fragments, two per split at most, which are joined by file.
"""

from __future__ import annotations

import csv
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A quoted field that begins and ends in the line, or one that does not end in it.
_QUOTED = re.compile('"(?:[^"]|"")*(?P<end>"(?!")[^,]*|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that begins inside a quoted field (or not) end inside one?

    A quote opens a field only at the field's beginning; elsewhere in an unquoted field it is text.
    """
    if '"' not in line:
        return inside
    at = 0
    if inside:
        close = re.match('(?:[^"]|"")*"(?!")[^,]*', line)
        if close is None:
            return True
        at = close.end() + 1
    while at < len(line):
        if line[at] == '"':
            field = _QUOTED.match(line, at)
            if not field["end"]:
                return True
            at = field.end() + 1
        else:
            opens = line.find(',"', at)  # the next field that begins with a quote
            if opens < 0:
                return False
            at = opens + 1
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value) per line; the lines of a split stand together and in order."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches):
    """((file, start), lines) per run of lines of one split in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, value = (batch.column(c) for c in ("file", "start", "value"))
        moved = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = [0, *(np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield (file[a].as_py(), start[a].as_py()), value.slice(a, b - a).to_pylist()


def _by_split(batches):
    """(file, start, lines) per split, its lines as an iterator."""
    stream = _runs(batches)
    held = next(stream, None)
    while held is not None:
        key = held[0]

        def lines():
            nonlocal held
            while held is not None and held[0] == key:
                yield from held[1]
                held = next(stream, None)
        yield (*key, lines())


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): does the split begin inside a quoted field?"""

    def effects(batches):
        for file, start, rows in _by_split(batches):
            ends = [False, True]
            for line in rows:
                if '"' in line:
                    # once both states have met, they stay the same
                    ends = [ends_inside(line, ends[0])] * 2 if ends[0] == ends[1] else [ends_inside(line, e) for e in ends]
            yield pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([start], pa.int64()), "ends": pa.array([ends], pa.list_(pa.bool_()))})

    found = lines.mapInArrow(effects, "file string, start long, ends array<boolean>")
    splits = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "ends"))).alias("s"))  # one entry per split
    states = F.aggregate("s", F.array(F.lit(False)), lambda seen, s: F.array_append(seen, F.get(s["ends"], F.element_at(seen, -1).cast("int"))))
    return splits.select("file", F.inline(F.arrays_zip(F.transform("s", lambda s: s["start"]).alias("start"), F.slice(states, 1, F.size("s")).alias("inside"))))


def records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One CSV record per row (column ``record``), without the files' headers and without blank lines.

    A file whose header does not have the columns ``names`` is an error.
    """
    lines = _lines(spark, path)
    begins = F.broadcast(split_states(lines).where("inside").select("file", "start"))  # one row per split at most
    lines = lines.join(begins.withColumn("inside", F.lit(True)), ["file", "start"], "left")
    lines = lines.withColumn("value", F.concat(F.when(F.col("inside"), "1").otherwise("0"), "value")).drop("inside")

    def check(header: str):
        cells = next(csv.reader([header.removeprefix("﻿")]))
        if len(cells) != len(names) or any(c and not n.startswith(c) for c, n in zip(cells, names)):
            raise ValueError(f"the header {cells} does not name the columns {names}")

    def join(batches):
        for file, start, rows in _by_split(batches):
            out, open_lines, inside, head, first = [], [], None, False, start == 0

            def batch():
                columns = list(zip(*out)) if out else [[]] * 4
                return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())],
                                                  names=["file", "start", "part", "record"])
            for line in rows:
                if inside is None:
                    inside = head = line[0] == "1"
                line = line[1:]
                open_lines.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    record = "\n".join(open_lines).removesuffix("\r")
                    open_lines = []
                    if head:
                        # the end of a record of an earlier split
                        out.append((file, start, 0, "\n" + record))
                        head = False
                    elif first and not out:
                        check(record)
                        first = False
                    elif record.strip():
                        out.append((file, start, 1, record))
                    if len(out) >= 5000:
                        yield batch()
                        out = []
            if open_lines:
                # all of this split lies inside a record, or the record begins here
                text = "\n".join(open_lines)
                out.append((file, start, 0, "\n" + text) if head else (file, start, 2, text))
            yield batch()

    found = lines.mapInArrow(join, "file string, start long, part int, record string")
    whole = found.where("part = 1").select("record")
    pieces = found.where("part <> 1")
    upto = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)  # two rows per split at most
    pieces = pieces.withColumn("n", F.sum((F.col("part") == 2).cast("int")).over(upto))
    joined = pieces.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["record"]), "")
    return whole.unionByName(joined.select(F.regexp_replace(text, "\r$", "").alias("record")))


def parse(found: DataFrame, names: list[str]) -> DataFrame:
    """Columns c0, c1, ... of the records, as text; an empty field is null, as in a scan."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "lineSep": "\x01"})
    return found.select(row.alias("r")).select("r.*")
