r"""Repair of conversations whose turns were damaged, by bitsets of reachable grammar states in layers of increasing cost.

The initials of the roles must read ``(s?(ua)+)?``. A row may be kept (0), get the role user or assistant (1), be deleted (2), and an empty turn may be
inserted anywhere (5); blank and repeated rows must be deleted, and truncated rows that stay cost 5 more. Of the cheapest repairs the one whose
edit letters (D, I, K, R) come first in ASCII order is taken.

A turn has a machine word whose fourth part of a byte for layer ``c`` is the set of grammar states from which the rows from there on can be repaired at
a cost of at most ``c``. A row updates all layers at once by shifts and masks, from the last row to the first (the update of Wu and Manber, with
cost layers in place of error counts). The first layer at the first turn that holds the start state is the cost, and the words are then
read forwards, which gives the least audit. From any state every other one's repair is at most 10 dearer (delete a
system turn and insert two turns), so a word needs 11 layers above the cheapest one, which is kept beside it: a row costs a constant time
and 12 bytes, however long the conversation and dear its repair.

Two passes over the sorted rows, so that no text is held: the first one sees a code for each row and yields the audit; in the second one the audit precedes
the rows, and the repaired text is hashed as they pass by. A SHA-256 over a conversation is sequential, so one conversation is one task; its sorts spill.

Null roles and texts, and null keys in the damage's hash, count as one space. A null conv_id is a conversation of its own, null turns come first,
rows of equal turn are ordered by role, then text, and repeated rows stay repeated. A role's initial is its first character; any but s, u and a (an empty role too) fits
nowhere until it gets another role. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = r"[\x20\x09-\x0D]"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Grammar states as bits: nothing yet, after s, after u, after a (which may end, as nothing may). What may follow: state to (initial, next state).
START, S, U, A = 1, 2, 4, 8
AFTER = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
FINAL = START | A
ROLES = {"u": "user", "a": "assistant"}
LAYERS, SPAN = 11, 28  # layers that differ, and those of a word while it is being updated
_ONES = int("1" * SPAN, 16)
_FULL = (_ONES * 15) >> (4 * LAYERS) << (4 * LAYERS)  # layers from LAYERS on hold all states
_MASK = (1 << (4 * LAYERS)) - 1


def _before(word: int, initial: str) -> int:
    """In every layer, the states from which a turn of ``initial`` leads into the layer's set."""
    out = 0
    for state, moves in AFTER.items():
        if initial in moves:
            out |= (word >> (moves[initial].bit_length() - 1) & _ONES) * state
    return out


def _with_inserts(word: int) -> int:
    for _ in range(2):  # an inserted turn after two more comes back to where it was
        word |= (_before(word, "u") | _before(word, "a")) << (4 * INSERT)
    return word


def _settled(word: int) -> tuple[int, int]:
    """``word`` from its first layer with a state on, and the number of that layer."""
    word &= _ONES * 15
    base = 0
    while not word & 15:
        word >>= 4
        base += 1
    return word & _MASK, base


@lru_cache(maxsize=None)
def last_word() -> tuple[int, int]:
    return _settled(_with_inserts(_ONES * FINAL))


@lru_cache(maxsize=1 << 16)
def earlier_word(word: int, initial: str, fault: int) -> tuple[int, int]:
    """The word before a row, and by how much its cheapest layer is dearer."""
    word |= _FULL
    out = word << (4 * DELETE)
    if FAULTS[fault] not in ("blank", "duplicate"):
        stays = 4 * TRUNCATED if FAULTS[fault] == "truncated" else 0
        out |= _before(word, initial) << stays | (_before(word, "u") | _before(word, "a")) << (4 * REROLE + stays)
    return _settled(_with_inserts(out))


def repair(initials: list[str], faults: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    n = len(initials)
    words, bases = array("Q", bytes(8 * (n + 1))), array("l", bytes(array("l").itemsize * (n + 1)))
    words[n], bases[n] = last_word()
    for i in range(n - 1, -1, -1):
        words[i], more = earlier_word(words[i + 1], initials[i], faults[i])
        bases[i] = bases[i + 1] + more

    def can(i: int, state: int, cost: int) -> bool:
        c = cost - bases[i]
        return c >= LAYERS or (c >= 0 and bool(words[i] >> (4 * c) & state))

    cost = next(c for c in range(bases[0], bases[0] + LAYERS + 1) if can(0, START, c))
    i, state, left, audit = 0, START, cost, []
    while i < n or not (state & FINAL and left == 0):
        inserted = AFTER[state].get("u") or AFTER[state]["a"]
        stays = TRUNCATED if i < n and FAULTS[faults[i]] == "truncated" else 0
        may = i < n and FAULTS[faults[i]] not in ("blank", "duplicate")
        kept = AFTER[state].get(initials[i]) if may else None
        if i < n and can(i + 1, state, left - DELETE):
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif can(i, inserted, left - INSERT):
            audit.append("I")
            state, left = inserted, left - INSERT
        elif kept and can(i + 1, kept, left - stays):
            audit.append("K")
            i, state, left = i + 1, kept, left - stays
        else:
            audit.append("R")
            i, state, left = i + 1, inserted, left - stays - REROLE
    return cost, "".join(audit)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that ``audit`` makes of ``rows``; ``rows`` are read one at a time."""
    state = START
    for edit in audit:
        due = "u" if "u" in AFTER[state] else "a"
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[due]
        yield role, text
        state = AFTER[state][role[:1]]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of ``turns`` after damage by ``crc32(conv_id:turn) % 20``; a dropped row stays, without role and text."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    role = F.when(kind == 0, None).when(kind == 4, "user").otherwise(F.col("role"))
    text = F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def _fault(again: Column) -> Column:
    seen = F.regexp_replace("text", f"^{BLANKS}+|{BLANKS}+$", "")
    return F.when(F.col("dropped"), 0).when(seen == "", 1).when(again, 2).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), 3).otherwise(0).cast("int")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each conversation, its key and an iterator over its rows, which must be read out before the next one."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                now, ahead = ahead, next(rows, None)
                yield now

        it = own()
        yield key, it
        for _ in it:
            pass


REPORT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def diagnosed(rows: DataFrame) -> DataFrame:
    """Of each conversation of ``rows`` (as ``damaged`` has them): gaps, the counts of faults and of illegal neighbours, and cost and audit of its repair."""
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    coded = rows.repartition("conv_id").withColumn("fault", _fault(again)).sortWithinPartitions("conv_id", "turn", "role", "text")
    out = REPORT.format(kind=dict(rows.dtypes)["conv_id"])
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in "gaps blank duplicate truncated illegal cost".split()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports() -> Iterator[tuple]:
            for key, own in _streams(batches):
                initials, faults = [], bytearray()
                counts, distinct, low, high, illegal = [0] * 4, 0, None, None, 0
                for _, turn, initial, dropped, fault in own:
                    if dropped:
                        continue
                    if turn is not None and turn != high:  # in order of turns
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                    illegal += bool(initials) and initials[-1] + initial not in ("su", "ua", "au")
                    initials.append(initial)
                    faults.append(fault)
                    counts[fault] += 1
                yield key, 0 if low is None else high - low + 1 - distinct, *counts[1:], illegal, *repair(initials, faults)

        held: list[tuple] = []
        for r in reports():
            held.append(r)
            if len(held) == 1000 or len(r[-1]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return coded.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"), "dropped", "fault").mapInArrow(run, out)


def repaired_digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` (as ``diagnosed`` gives them) with repaired_sha256, of ``role:text`` of the repaired turns, joined by newlines."""
    names = reports.columns
    empty = rows.where("not dropped").select("conv_id", F.lit(1).alias("__after"), "turn", "role", "text", *(F.lit(None).cast(t).alias(f"_{n}") for n, t in reports.dtypes))
    first = reports.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), *names)
    both = empty.union(first).repartition("conv_id").sortWithinPartitions("conv_id", "__after", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def results() -> Iterator[tuple]:
            for _, own in _streams(batches):
                report = next(own)[4:]
                digest, started = hashlib.sha256(), False
                for role, text in edited(report[-1], ((r[2], r[3]) for r in own)):
                    digest.update((("\n" if started else "") + f"{role}:{text}").encode())
                    started = True
                yield *report, digest.hexdigest()

        types = [pa.int64()] * (len(names) - 1) + [pa.string(), pa.string()]
        held: list[tuple] = []
        for r in results():
            held.append(r)
            if len(held) == 1000 or len(r[-2]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names=[*names, "repaired_sha256"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names=[*names, "repaired_sha256"])

    return both.mapInArrow(run, REPORT.format(kind="long") + ", repaired_sha256 string")


def repaired_turns(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, seq, role, text: the repaired conversations themselves, a row for each turn."""
    first = reports.select("conv_id", F.lit(0).alias("__after"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = first.union(rows.where("not dropped").select("conv_id", F.lit(1), "turn", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "__after", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seq", "role", "text"]
        pack = lambda held: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), [pa.int64(), pa.int64(), pa.string(), pa.string()])], names=names)
        held: list[tuple] = []
        for key, own in _streams(batches):
            for seq, (role, text) in enumerate(edited(next(own)[3], ((r[2], r[3]) for r in own))):
                held.append((key, seq, role, text))
                if len(held) == 500:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return both.select("conv_id", "__after", "role", "text").mapInArrow(run, "conv_id long, seq long, role string, text string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repaired_digests(rows, diagnosed(rows))
