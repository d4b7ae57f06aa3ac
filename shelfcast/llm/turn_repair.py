"""Conversation structure repair: the cheapest edits that give a conversation the role order (system? (user assistant)+)?."""

from __future__ import annotations

import hashlib
from array import array
from collections import namedtuple
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import prepare, store, table

#: Prices of the edits; a truncated row that stays adds one more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
EDITS = "DIKR"
#: What the output has so far: nothing, a system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: The one role that may follow, for rows that are inserted or get another role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LETTER = {START: "", SYSTEM: "s", USER: "u", ASSISTANT: "a"}

#: Rows that a long conversation's search takes at a time.
STRETCH = 64

#: A row as the search sees it: its role's initial ("" for an empty role, x for one that fits nowhere), must it go, is it truncated.
Turn = namedtuple("Turn", "initial forced truncated")


def follows(left: str, right: str) -> bool:
    """May these two neighbours both stay as they are?  left "" is the beginning, right "" the end."""
    return right == "a" if left == "u" else right in ("u", "s") if left == "" else right in ("u", "") if left == "a" else right == "u"


class Bound:
    """A lower bound of the price of a stretch of rows from ``i`` on, given what the output has so far.

    ``last`` says that the conversation ends with the stretch; if not, what comes next is unknown.

    Rows that must go cost 3, truncated ones at least 1.  Two neighbours that cannot both stay
    need an edit at one of them or between them; an edit touches two such pairs at most, and costs
    2 or more: a run of L pairs needs ceil(L / 2) edits.  In a run of two around a row that cannot
    stay whatever comes before, giving it another role helps only if its neighbours then fit; if
    not, and it is not truncated, the cheapest way is to delete it, for 3.
    """

    def __init__(self, rows: list, last: bool = True):
        n, self.last = len(rows), last
        self.base = array("q", [0]) * (n + 1)
        self.at = array("q", [0]) * (n + 1)
        self.stay = [r for r in rows if not r.forced and r.initial]
        m = len(self.stay)
        self.at[n] = m
        for i in range(n - 1, -1, -1):
            r = rows[i]
            self.base[i] = self.base[i + 1] + (DELETE if r.forced else TRUNCATED if r.truncated else 0)
            self.at[i] = self.at[i + 1] - (not r.forced and r.initial != "")
        # once anything has been put out, a system row cannot stay either
        self.runs = [self._runs(m, begun) for begun in (False, True)]

    def _clash(self, j: int, begun: bool) -> bool:
        left = self.stay[j].initial
        if left == "x" or begun and left == "s":
            return True
        if j + 1 == len(self.stay):
            return self.last and not follows(left, "")
        return self.stay[j + 1].initial == "s" or not follows(left, self.stay[j + 1].initial)

    def _runs(self, m: int, begun: bool):
        run, tail = array("q", [0]) * (m + 1), array("q", [0]) * (m + 1)
        for j in range(m - 1, -1, -1):
            if self._clash(j, begun):
                run[j] = 1 + run[j + 1]
                tail[j] = self._price(run[j], self.stay[j].initial, j + 1, begun) + tail[j + run[j]]
            else:
                tail[j] = tail[j + 1]
        return run, tail

    def _price(self, length: int, left: str, j: int, begun: bool) -> int:
        if length == 2 and j + (not self.last) < len(self.stay):
            mid = self.stay[j]
            if not mid.truncated and (mid.initial == "x" or begun and mid.initial == "s") and left in ("", "u", "a"):
                right = self.stay[j + 1].initial if j + 1 < len(self.stay) else ""
                if not follows("a" if left == "u" else "u", right):
                    return 3
        return 2 * ((length + 1) // 2)

    def __call__(self, i: int, state: int) -> int:
        begun = state != START
        run, tail = self.runs[begun]
        j = self.at[i]
        right = self.stay[j].initial if j < len(self.stay) else ""
        if right == "" and (state == START or not self.last) or (follows(LETTER[state], right) and not (begun and right == "s")):
            return self.base[i] + tail[j]
        length = 1 + (run[j] if j < len(self.stay) else 0)
        return self.base[i] + self._price(length, LETTER[state], j, begun) + tail[min(j + length - 1, len(self.stay))]


def repair(rows: list) -> tuple[int, str]:
    """Price and audit (initials of the edits) of the cheapest repair of ``Turn`` rows; of equally cheap ones the ASCII-least.

    Iterative-deepening A*: depth first, edits in ASCII order, under a bound that grows to the
    least price not yet tried.  A state is a row and what the output ends with.  The table holds,
    for each state that failed, the least price it still needs as far as is known; a state is
    left alone while that exceeds what the bound leaves.  Under the first bound that any path
    meets, the first path found is the ASCII-least of the cheapest.  Stretches of rows are
    searched from the back, so that the price from each stretch's end is known when those before
    it are searched: the time is proportional to the rows.
    """
    n = len(rows)
    starts = list(range(0, max(n, 1), STRETCH))
    known = array("q", [-1]) * (4 * (n + 1))

    def search(a: int, state: int, bound_of: Bound, rest: int) -> tuple[list, int]:
        """Edits of the first path from a state at row ``a`` to its stretch's end under the least bound, and the state there."""
        end = min(a + STRETCH, n)

        def least(i: int, state: int) -> int:
            k = 4 * i + state
            if known[k] < 0:
                known[k] = bound_of(i - a, state) + rest
            return known[k]

        def steps(i: int, state: int):
            """(price, row, state) per edit in ASCII order, None where the edit cannot be made."""
            insert = (INSERT, i, NEXT[state])
            if i == end:
                return None, insert, None, None
            row = rows[i]
            delete = (DELETE, i + 1, state)
            if row.forced:
                return delete, insert, None, None
            stay = TRUNCATED if row.truncated else 0
            after = AFTER.get((state, row.initial)) if row.initial else state
            return delete, insert, None if after is None else (KEEP + stay, i + 1, after), (REROLE + stay, i + 1, NEXT[state])

        while True:
            # a path: per depth the state, what the bound leaves there, and the edit tried now
            path, left, tried = [(a, state)], [least(a, state)], [-1]
            while path:
                row, now = path[-1]
                if row == end and (end < n or now in (START, ASSISTANT)):
                    return tried[:-1], now
                options = steps(row, now)
                for t in range(tried[-1] + 1, 4):
                    step = options[t]
                    if step is not None and step[0] + least(step[1], step[2]) <= left[-1]:
                        tried[-1] = t
                        path.append(step[1:])
                        left.append(left[-1] - step[0])
                        tried.append(-1)
                        break
                else:
                    known[4 * row + now] = max(least(row, now), min(s[0] + least(s[1], s[2]) for s in options if s is not None))
                    path.pop()
                    left.pop()
                    tried.pop()

    bounds = {}
    for a in reversed(starts):
        end = min(a + STRETCH, n)
        bounds[a] = Bound(rows[a:end], end == n), 0 if end == n else min(known[4 * end:4 * end + 4])
        for state in range(4) if a else (START,):
            search(a, state, *bounds[a])
    audit, state = [], START
    for a in starts:
        edits, state = search(a, state, *bounds[a])
        audit += edits
    return known[START], "".join(EDITS[t] for t in audit)


@lru_cache(50_000)
def repair_short(rows: tuple) -> tuple[int, str]:
    return repair(rows)


# ------------------------------------------------------------------ faults, by conversation

ORDER = ["turn", "role", "text", "again"]


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a conversation together in one partition; null is a conversation of its own."""
    return df.withColumn("key", F.xxhash64("conv_id")).repartition("key")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with the first fault of every row: blank, duplicate, truncated or none.

    ``again`` counts equal rows (role and text) of the conversation before this one.  Rows that are
    ``gone`` stand only for their conversation's existence.
    """
    order = Window.partitionBy("key", "conv_id", "gone", "role", F.sha2("text", 256)).orderBy("turn")
    rows = dealt(rows).withColumn("again", F.row_number().over(order) - 1)
    rows = rows.withColumn("last", F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1)))
    fault = F.when(F.col("last") == "", "blank").when(F.col("again") > 0, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).drop("last")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation of ``faults`` rows.

    A task sees a conversation's rows in order and holds a few bytes of each, never its texts.
    """
    kind = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def report(conv, turns, numbers, faults, illegal):
        turns = tuple(turns)
        cost, audit = repair_short(turns) if len(turns) <= 64 else repair(list(turns))
        gaps = numbers[1] - numbers[0] + 1 - numbers[2] if numbers else 0
        return conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit

    def run(batches):
        names = [x.split()[0] for x in kind.split(", ")]
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in kind.split(", ")])
        out = []
        conv, turns = None, None
        for batch in batches:
            for c, turn, initial, fault, gone in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "initial", "fault", "gone"))):
                if turns is None or c != conv:
                    if turns is not None:
                        out.append(report(conv, turns, numbers, found, illegal))
                    conv, turns, numbers, found, illegal, before = c, [], None, dict(blank=0, duplicate=0, truncated=0), 0, None
                if gone:
                    continue
                if turn is not None:
                    numbers = (turn, turn, 1) if numbers is None else (numbers[0], turn, numbers[2] + (turn != numbers[1]))
                if fault:
                    found[fault] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                turns.append(Turn(initial if initial in ("s", "u", "a", "") else "x", fault in ("blank", "duplicate"), fault == "truncated"))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out = []
        if turns is not None:
            out.append(report(conv, turns, numbers, found, illegal))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    rows = rows.sortWithinPartitions("key", "conv_id", "gone", *ORDER)
    return rows.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "gone").mapInArrow(run, kind)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, position, edit (K, R or I), turn, role, text of the repaired conversations.

    A conversation's rows stand together and in order.  Its audit comes first in the sorted
    stream, then its rows one after another: a task never holds a conversation.
    """
    heads = reports.select("conv_id", F.lit(False).alias("gone"), "audit")
    stream = dealt(rows.where("NOT gone").drop("key", "fault").unionByName(heads, allowMissingColumns=True))
    stream = stream.sortWithinPartitions("key", "conv_id", F.col("audit").isNull(), *ORDER)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        audit, at, state, position = "", 0, START, 0
        for batch in batches:
            out = []

            def put(conv, edit, turn, role, text):
                nonlocal position, at
                out.append((conv, position, edit, turn, role, text))
                position += 1
                at += 1

            def inserts(conv):
                nonlocal state
                while audit[at:at + 1] == "I":
                    state = NEXT[state]
                    put(conv, "I", None, ROLE_OF[state], "")

            for conv, head, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "turn", "role", "text"))):
                if head is not None:
                    audit, at, state, position = head, 0, START, 0
                    inserts(conv)
                    continue
                edit = audit[at]
                if edit == "D":
                    at += 1
                elif edit == "K":
                    state = AFTER[state, role[0]] if role else state
                    put(conv, "K", turn, role, text)
                else:
                    state = NEXT[state]
                    put(conv, "R", turn, ROLE_OF[state], text)
                inserts(conv)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)

    return stream.select("conv_id", "audit", "turn", "role", "text").mapInArrow(run, "conv_id long, position long, edit string, turn long, role string, text string")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired rows) of (conv_id, turn, role, text, gone).

    Rows stand by turn, nulls first; rows of one turn by role and text.  A row's first fault
    counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (the last character that is not white space is none of ``.!?``).
    Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank and duplicate
    rows), Insert an empty user or assistant row 2; a truncated row that stays adds 1.  Role, text and
    ``gone`` must not be null; a null conv_id is a conversation of its own.  A conversation whose
    rows are all ``gone`` has zeros and an empty audit; an empty table has no reports.
    """
    prepare(rows.sparkSession)
    marked = faults(rows)
    reports = store(audits(marked))
    return reports, repaired(marked, reports)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows in their order: SHA-256 of ``role:text``, joined by newlines."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, sha, out = None, None, []
        for batch in batches:
            for c, position, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            out.append((conv, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 takes the row out (``gone``), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    makes its role user.  Columns other than conv_id, turn, role and text are not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), how.alias("how"), blank("role").alias("role"), blank("text").alias("text"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), "how")
    return rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "how")


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    reports, rows = repair_conversations(damaged(table(spark, sf_dir, "conversations")))
    sha = digests(rows).withColumnRenamed("conv_id", "__id")
    out = reports.join(sha, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
