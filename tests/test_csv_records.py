"""Records with line breaks in quoted fields, from files that are read in many splits."""

import csv
import random

import pytest

from shelfcast.sources.files import read_csv
from shelfcast.sources.records import ends_inside, parse, records


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('"a",b', False, False), ('"a', True, False), ('a"', False, False), ('5" pipe,x', False, False), ('a,"b""', True, False),
    ('a,"b"",c', True, False), ('"",""', False, True), ('"', True, False), ('""', False, True), ("", False, True), ('x","y', True, True), ('"a"b,"c', True, True)])
def test_a_line_ends_inside(line, outside, inside):
    assert ends_inside(line, False) == outside and ends_inside(line, True) == inside


def random_rows(n, seed):
    rng = random.Random(seed)
    pieces = ["a", '"', ",", "\n", "\r\n", " ", "é", "long text " * 5, "1"]

    def cell():
        return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
    return [[str(i), *(cell() for _ in range(3))] for i in range(n)]


@pytest.fixture
def splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(before, (size, "0"))]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["37b", "1k", "128m"])
def test_records_of_any_splits_are_those_of_the_whole_file(spark, splits, tmp_path, size):
    rows = {}
    for f, n in (("a", 60 if size == "37b" else 900), ("b", 40)):
        rows[f] = random_rows(n, f)
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            csv.writer(out, lineterminator="\n" if f == "a" else "\r\n").writerows([["id", "x", "y,z", "w"], *rows[f]])
    splits(size)
    found = records(spark, str(tmp_path), ["id", "x", "y,z", "w"])
    assert size == "128m" or found.rdd.getNumPartitions() > 8
    # the parser takes every line end inside a field as a newline, and an empty field as null
    plain = lambda r: tuple(c.replace("\r\n", "\n") or None for c in r)
    got = sorted((tuple(None if c is None else c.replace("\r\n", "\n") for c in r) for r in parse(found, ["id", "x", "y,z", "w"]).collect()), key=repr)
    assert got == sorted((plain(r) for f in rows.values() for r in f), key=repr)


def test_one_field_over_many_splits(spark, splits, tmp_path):
    body = "\n".join(f"line {i}, with \"\"quotes\"\"" for i in range(400))
    (tmp_path / "a.csv").write_text(f'id,text\n1,short\n2,"{body}"\n3,end')
    splits("500b")
    got = {r.id: r.text for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: "short", 2: body.replace('""', '"'), 3: "end"}


def test_other_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,x\n")
    (tmp_path / "b.csv").write_text("text,id\nx,1\n")
    with pytest.raises(Exception, match="does not name the columns"):
        read_csv(spark, str(tmp_path))


def test_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    assert read_csv(spark, str(tmp_path)).count() == 0


def test_line_states_against_a_scan_by_characters():
    import itertools

    from shelfcast.sources.records import ends_inside

    def scan(line, inside):
        begins, i = not inside, 0
        while i < len(line):
            if inside:
                if line[i] == '"' and line[i + 1:i + 2] == '"':
                    i += 1
                elif line[i] == '"':
                    inside = False
            elif line[i] == '"' and begins:
                inside = True
            begins = not inside and line[i] == ","
            i += 1
        return inside
    for n in range(7):
        for cells in itertools.product('a,"', repeat=n):
            line = "".join(cells)
            assert [ends_inside(line, e) for e in (False, True)] == [scan(line, e) for e in (False, True)], line


def test_runs_of_lines_are_those_of_their_splits():
    import pyarrow as pa

    from shelfcast.sources.records import _by_split
    rows = [("f", 0, "a"), ("f", 0, "b"), ("f", 9, "c"), ("g", 9, "d"), ("g", 9, "e"), ("g", 20, "f")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("file", "start", "value"), r)) for r in part],
                                          schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("value", pa.string())])) for part in (rows[:1], [], rows[1:4], rows[4:])]
    assert [(f, s, list(v)) for f, s, v in _by_split(iter(batches))] == [("f", 0, ["a", "b"]), ("f", 9, ["c"]), ("g", 9, ["d", "e"]), ("g", 20, ["f"])]


def test_types_are_inferred_in_code_that_the_jvm_compiles(spark, tmp_path):
    from shelfcast.sources.files import read_csv
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\"y\nz\"\n")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "y\nz")]
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
