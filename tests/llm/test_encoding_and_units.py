"""Words encoded by the library's model alone; units of near-duplicate candidates merged where they overlap."""

import re

from shelfcast.llm import near_dedup, records
from shelfcast.llm.common import prepare


def test_records_words_of_letters_go_to_the_model():
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path(records.VOCABULARY))
    letters = [c for c in map(chr, range(0x250)) if re.fullmatch(f"[{records.LATIN}]", c)]
    texts = ["".join(letters), " ".join(f"a{c}b" for c in letters), "it's  Cœur, naïve's\tX y <|endoftext|>w 12 a1 -b", " ʼn", ""]
    encoder, sent = records.LibraryEncoder(records.VOCABULARY), []

    class Spy:
        def encode_batch_fast(self, missing, **options):
            sent.extend(missing)
            return library.encode_batch_fast(missing, **options)

    encoder.tokenizer = Spy()
    got = encoder.encode(texts)
    assert got == [records.array("H", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert sent and not [m for m in sent if re.fullmatch(f" ?[{records.LATIN}]+", m)]


def units_of(spark, *units):
    rows = [(u, c, c, 10) for u, members in enumerate(units) for c in members]
    return spark.createDataFrame(rows, "unit long, cls long, comp long, n long")


def members(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.unit, []).append(r.cls)
    return sorted(map(sorted, found.values()))


def test_near_dedup_overlapping_units_travel_once(spark, monkeypatch):
    prepare(spark)
    units = units_of(spark, [1, 2], [2, 3], [1, 2, 3], [8, 9], [20, 21, 22, 23], [23, 24])
    got, seen = near_dedup.merged_units(units, 6)
    assert members(got) == [[1, 2, 3], [8, 9], [20, 21, 22, 23, 24]]
    # what one group has confirmed is not asked again; a unit with one new document, or of two groups, is
    later = near_dedup.unseen_units(units_of(spark, [1, 3], [9, 8], [2, 4], [3, 8], [30, 31]), seen)
    assert members(later) == [[2, 4], [3, 8], [30, 31]]
    # labels of another call differ, though the smallest documents are the same
    assert not {r.seen for r in seen.collect()} & {r.seen for r in near_dedup.merged_units(units, 20)[1].collect()}
    # groups above a limit stay as units
    monkeypatch.setattr(near_dedup, "GROUP_LIMIT", 4)
    assert members(near_dedup.merged_units(units, 6)[0]) == [[1, 2, 3], [8, 9], [20, 21, 22, 23], [23, 24]]
    monkeypatch.setattr(near_dedup, "BLOCK_ITEMS", 25)
    got, seen = near_dedup.merged_units(units, 6)
    assert members(got) == [[1, 2], [1, 2, 3], [2, 3], [8, 9], [20, 21, 22, 23], [23, 24]]
    assert sorted(r.cls for r in seen.collect()) == [8, 9]


def test_near_dedup_long_chain_of_units_is_left_as_it_is(spark):
    prepare(spark)
    chain = units_of(spark, *([i, i + 1] for i in range(12)))
    got = members(near_dedup.merged_units(chain, 6)[0])
    assert all(any({i, i + 1} <= set(m) for m in got) for i in range(12))
