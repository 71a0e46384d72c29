"""Repair of conversations whose turns are damaged: the cheapest edits that give `(s?(ua)+)?`.

The edits are found by Dijkstra on a lattice that is never built: a node is (rows consumed, grammar
state), the priority is (cost, audit), and the first accepting end node that is popped is the answer.
Two audits of one cost and node never begin with one another, for an insertion costs something, so that the
least audit of a node goes on to be the least whatever follows. The same holds for runs of rows: a long conversation is
cut into blocks, each searched from every state, and the blocks' results are put together in order.

Rows are ordered by ranges of (conversation, turn, ...), so that a conversation with a third of all rows is
many ranges. One that lies within a range is repaired there and then; those at the ends of ranges meet in
a second step, by blocks if they are long.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import partitions, written

WHITE = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
#: The only turn that may be put in, or that a row may be made, in each state.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
INITIALS = "sua?"
#: First faults, as a row's kind carries them above the two bits of its role's initial.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
REROLE, DELETE, INSERT = 2, 3, 2
#: Rows that one search takes; longer runs are cut.
BLOCK = 512
#: Rows of a conversation at the ends of ranges that one task repairs whole.
LONG = 4096


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of conversations, a twentieth each dropped, emptied, without sentence ends, repeated, or made the user's, by crc32 of `conv_id:turn`.

    A null is one space, in the digest too. Rows that repeat are damaged alike. A dropped row stays, marked and empty, so that its conversation is known.
    """

    def given(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(fate <= 1, "").when(fate == 2, F.translate(given("text"), ".!?", "")).otherwise(given("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(given("role")).alias("role"), text.alias("text"), (fate == 0).alias("dropped"), F.when(fate == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


def kind_of(role: str, text: str, seen: bool) -> int:
    """A row's initial and first fault as one number."""
    kept = text.rstrip(WHITE)
    fault = BLANK if not kept else DUPLICATE if seen else FINE if kept[-1] in ".!?" else TRUNCATED
    return (INITIALS.index(role[0]) if role and role[0] in "sua" else 3) | fault << 2


def search(kinds: bytes, start: int, accepting: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) over the rows from `start` to each end state that can be reached; with `accepting`, to the first of those that is popped, alone."""
    heap, done, ends = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds):
            ends[state] = cost, audit
            if accepting and state in accepting:
                return {state: ends[state]}
        wanted = NEXT[state, WANTED[state]]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, wanted))
        if i < len(kinds):
            initial, fault = INITIALS[kinds[i] & 3], kinds[i] >> 2
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault < BLANK:
                heapq.heappush(heap, (cost + REROLE + fault, audit + "R", i + 1, wanted))
                if (state, initial) in NEXT:
                    heapq.heappush(heap, (cost + fault, audit + "K", i + 1, NEXT[state, initial]))
    return ends


def put_together(blocks: Iterable[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str, list[tuple[int, int]]]:
    """The least (cost, audit) through blocks, each given as its ends by the state that it begins in; and for each block that state and where in the audit it begins."""
    ends: dict[int, tuple] = {START: (0, "", None)}
    for block in blocks:
        new: dict[int, tuple] = {}
        for state, (cost, audit, path) in ends.items():
            for end, (more, then) in block[state].items():
                if end not in new or cost + more <= new[end][0]:
                    found = cost + more, audit + then, (path, state, len(audit))
                    new[end] = min(new.get(end, found), found, key=lambda f: f[:2])
        ends = new
    cost, audit, path = min((ends[state] for state in ACCEPTING if state in ends), key=lambda f: f[:2])
    begins = []
    while path:
        path, *at = path
        begins.append(tuple(at))
    return cost, audit, begins[::-1]


def from_every_state(kinds: bytes) -> dict[int, dict[int, tuple[int, str]]]:
    return {state: search(kinds, state) for state in range(4)}


def cheapest(kinds: bytes) -> tuple[int, str]:
    """The least (cost, audit) that repairs rows of these kinds."""
    if len(kinds) <= BLOCK:
        return next(iter(search(kinds, START, ACCEPTING).values()))
    return put_together(from_every_state(kinds[at : at + BLOCK]) for at in range(0, len(kinds), BLOCK))[:2]


def edited(audit: str, roles: Iterable[str], texts: Iterable[str], state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of each repaired turn; the audit and the state that it begins in say all."""
    rows = zip(roles, texts)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            state = NEXT[state, role[0] if edit == "K" else WANTED[state]]
            yield (role if edit == "K" else NAMES["a" if state == ASSISTANT else "u"]), text


class Facts(NamedTuple):
    """What is counted over a run of rows, and what its neighbours need to know."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: int | None = None
    last: int | None = None

    @classmethod
    def of(cls, kinds: bytes, turns: list) -> Facts:
        faults = [k >> 2 for k in kinds]
        known = [t for t in turns if t is not None]
        pairs = zip(kinds, kinds[1:])
        illegal = sum(not legal(a, b) for a, b in pairs)
        return cls(faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, len(set(known)), min(known, default=None), max(known, default=None), kinds[0] & 3, kinds[-1] & 3) if kinds else cls()

    def then(self, more: Facts) -> Facts:
        """Both runs as one; rows are in order of turn."""
        if self.first is None or more.first is None:
            return more if self.first is None else self
        counts = [a + b for a, b in zip(self[:5], more[:5])]
        counts[3] += not legal(self.last, more.first)
        counts[4] -= self.high is not None and self.high == more.low
        return Facts(*counts, more.low if self.low is None else self.low, self.high if more.high is None else more.high, self.first, more.last)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def legal(a: int, b: int) -> bool:
    return INITIALS[a & 3] + INITIALS[b & 3] in ("su", "ua", "au")


def digest(turns: Iterable[tuple[str, str]]) -> str:
    """sha256 of `role:text` lines."""
    found, between = hashlib.sha256(), ""
    for role, text in turns:
        found.update(f"{between}{role}:{text}".encode())
        between = "\n"
    return found.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(facts: Facts, cost: int, audit: str) -> list:
    return [facts.gaps, facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit]


class _Whole:
    """A conversation's rows, held while they come; dropped ones have no role."""

    def __init__(self, rows: list[tuple]) -> None:
        kept = [r for r in rows if r[1] is not None]
        self.turns, self.roles, self.texts = ([r[i] for r in kept] for i in range(3))
        seen: set = set()
        self.kinds = bytes(kind_of(role, text, (role, text) in seen or bool(seen.add((role, text)))) for role, text in zip(self.roles, self.texts))

    def repair(self) -> tuple[int, str, list[tuple[str, str]]]:
        cost, audit = cheapest(self.kinds)
        return cost, audit, list(edited(audit, self.roles, self.texts))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """(key, rows) of each conversation of a partition in order; a row is the other columns."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, found in groupby(rows(), lambda r: r[0]):
        yield key, [r[1:] for r in found]


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)


def _names(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).fieldNames()


def _in_ranges(texts: bool):
    """Of each partition: a report on each conversation that is neither its first nor its last, with the repaired turns if asked; rows of those two as they are, with their kinds as far as the range knows them."""
    schema = to_arrow_schema(StructType.fromDDL(_FOUND))
    blank, reported = dict.fromkeys(_names(_FOUND)), _names(REPORT)

    def ends(key: str, rows: list[tuple]) -> list[list]:
        seen: set = set()
        out = []
        for at, (turn, role, text, range_) in enumerate(rows):
            kind, like = None, None
            if role is not None:
                like = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}")
                kind = kind_of(role, text, like in seen)
                seen.add(like)
                like = like if kind >> 2 in (FINE, TRUNCATED) else None
            out.append(list((blank | {"key": key, "range": range_, "at": at, "turn": turn, "role": role, "text": text, "kind": kind, "like": like}).values()))
        return out

    def whole(key: str, rows: list[tuple]) -> list[list]:
        held = _Whole(rows)
        cost, audit, repaired = held.repair()
        report = dict(zip(reported, [*_reported(Facts.of(held.kinds, held.turns), cost, audit), digest(repaired)]))
        return [list((blank | report | {"key": key, "repaired": [{"role": r, "text": t} for r, t in repaired] if texts else None}).values())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for n, found in enumerate(_by_conversation(batches)):
            if before:
                yield _table((ends if n == 1 else whole)(*before), schema)
            before = found
        if before:
            yield _table(ends(*before), schema)

    return walk


_FOUND = f"key string, {REPORT}, repaired array<struct<role:string,text:string>>, range int, at long, turn long, role string, text string, kind int, like binary"
_TURNS = "key string, place long, role string, text string"


class Repair:
    """The repair of conversations (conv_id, turn, role, text, and perhaps dropped): report() is a row a conversation, turns() the repaired turns.

    Within a conversation rows are in order of turn, nulls first, then role, then the text's first characters and a
    hash of it. Null roles and texts are one space. Rows without a conv_id are one conversation. A role counts by its
    first letter; one without s, u or a can't be kept. A dropped row isn't there, but its conversation is reported, with
    zeros if no other row is. No rows: no reports. What is between the passes is written to the shared checkpoint folder.
    """

    def __init__(self, conversations: DataFrame, long: int = LONG, block: int = BLOCK) -> None:
        dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
        text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
        role = F.when(~dropped, F.coalesce(F.col("role").cast("string"), F.lit(" ")))
        key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
        rows = conversations.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        # rows that agree in everything may be in any order, so that a number that only tells them apart lets ranges part them
        order = ["key", "turn", "role", F.left("text", F.lit(64)), F.xxhash64("text"), "_copy"]
        rows = rows.withColumn("_copy", F.monotonically_increasing_id())
        ranged = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
        self.ranged = ranged.select("key", "turn", "role", "text", F.spark_partition_id().alias("range"))
        self.id_type, self.long, self.block = conversations.schema["conv_id"].dataType, long, block

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        found = written(self.ranged.mapInArrow(_in_ranges(False), _FOUND), "conversations")
        plans = self._long_plans(found)
        digests = self._long_digests(self._long_turns(found, plans))
        long = plans.where("block is null").select("key", *_names(REPORT)).drop("repaired_sha256").join(digests, "key", "left")
        long = long.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).select("key", *_names(REPORT))
        every = found.where("range is null").select("key", *_names(REPORT)).unionByName(self._short(found, True)).unionByName(long)
        return every.select(self._conv_id(), *_names(REPORT))

    def turns(self) -> DataFrame:
        """(conv_id, place, role, text) of all repaired turns, from place 0 in each conversation."""
        found = written(self.ranged.mapInArrow(_in_ranges(True), _FOUND), "conversations")
        whole = found.where("range is null").select("key", F.posexplode("repaired").alias("place", "t")).select("key", F.col("place").cast("long").alias("place"), "t.role", "t.text")
        every = whole.unionByName(self._short(found, False)).unionByName(self._long_turns(found, self._long_plans(found)))
        return every.select(self._conv_id(), "place", "role", "text")

    def _conv_id(self):
        return F.when(F.col("key") != "", F.expr("substr(key, 2)")).cast(self.id_type).alias("conv_id")

    def _ends(self, found: DataFrame, long: bool) -> DataFrame:
        """Rows of the long or the other conversations at the ends of ranges: two a range at most, so that the table of them that is broadcast is bounded."""
        rows = found.where("range is not null").select("key", "range", "at", "turn", "role", "text", "kind", "like")
        sizes = rows.groupBy("key").agg(F.count("role").alias("n"))
        return rows.join(F.broadcast(sizes.where(F.col("n") > self.long if long else F.col("n") <= self.long).select("key")), "key", "left_semi")

    def _short(self, found: DataFrame, report: bool) -> DataFrame:
        rows = self._ends(found, False).repartition("key").sortWithinPartitions("key", "range", "at").select("key", "turn", "role", "text")
        out = f"key string, {REPORT}" if report else _TURNS
        schema = to_arrow_schema(StructType.fromDDL(out))

        def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rows in _by_conversation(batches):
                held = _Whole(rows)
                cost, audit, repaired = held.repair()
                one = [[key, *_reported(Facts.of(held.kinds, held.turns), cost, audit), digest(repaired)]]
                yield _table(one if report else [[key, i, *t] for i, t in enumerate(repaired)], schema)

        return rows.mapInArrow(repair, out)

    def _long_rows(self, found: DataFrame) -> DataFrame:
        """Rows of long conversations with their kinds and blocks: a row is a duplicate, too, if a range before has its like."""
        rows = self._ends(found, True).where("role is not null")
        firsts = rows.where("like is not null").groupBy("key", "like").agg(F.min("range").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        asked = rows.where("like is not null").join(firsts, ["key", "like"], "left")  # of each text a row a range at most
        again = F.col("kind").bitwiseAND(3).bitwiseOR(DUPLICATE << 2)
        asked = asked.withColumn("kind", F.when(F.col("range") > F.col("_first"), again).otherwise(F.col("kind"))).drop("_first")
        return asked.unionByName(rows.where("like is null")).withColumn("block", F.floor(F.col("at") / self.block))

    def _long_plans(self, found: DataFrame) -> DataFrame:
        """For each long conversation a row with its report, and one for each block with its part of the audit, the state that it begins in and the place of its first turn.

        Only costs and audits of blocks pass through one task, in order.
        """
        searched = "key string, range int, block long, ends string, " + ", ".join(f"`{f}` long" for f in Facts._fields)
        columns = _names(searched)

        def search_block(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            kinds, head = bytes(rows["kind"].tolist()), rows.iloc[0]
            ends = "|".join(f"{a},{b},{cost},{audit}" for a, to in from_every_state(kinds).items() for b, (cost, audit) in to.items())
            turns = [None if t is None else int(t) for t in rows["turn"]]
            return pd.DataFrame([[head["key"], head["range"], head["block"], ends, *Facts.of(kinds, turns)]], columns=columns).astype({f: "Int64" for f in Facts._fields})

        rows = self._long_rows(found).select("key", "range", "block", "at", F.col("turn").cast("string").alias("turn"), "kind")
        blocks = rows.groupBy("key", "range", "block").applyInPandas(search_block, searched).repartition("key").sortWithinPartitions("key", "range", "block")
        out = f"key string, range int, block long, part string, state int, place long, {REPORT}"
        schema = to_arrow_schema(StructType.fromDDL(out))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, found in _by_conversation(batches):
                facts = Facts()
                for b in found:
                    facts = facts.then(Facts(*b[3:]))
                cost, audit, begins = put_together(_parsed(b[2]) for b in found)
                place, parts = 0, []
                for (range_, block, *_), (state, at), (_, end) in zip(found, begins, [*begins[1:], (0, len(audit))]):
                    parts.append([key, range_, block, audit[at:end], state, place, *[None] * 8])
                    place += end - at - audit.count("D", at, end)
                yield _table([[key, None, None, None, None, None, *_reported(facts, cost, audit), None], *parts], schema)

        return written(blocks.mapInArrow(put, out), "conversation-plans")

    def _long_turns(self, found: DataFrame, plans: DataFrame) -> DataFrame:
        parts = plans.where("block is not null").select("key", "range", "block", "part", "state", "place")
        rows = self._long_rows(found).select("key", "range", "block", "at", "role", "text").join(parts, ["key", "range", "block"])
        columns = _names(_TURNS)

        def edit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            head = rows.iloc[0]
            turns = list(edited(head["part"], rows["role"], rows["text"], int(head["state"])))
            return pd.DataFrame([[head["key"], head["place"] + i, *t] for i, t in enumerate(turns)], columns=columns)

        return rows.groupBy("key", "range", "block").applyInPandas(edit, _TURNS)

    def _long_digests(self, turns: DataFrame) -> DataFrame:
        """(key, repaired_sha256): a digest is made turn by turn, so that a conversation's turns stream through one task."""
        out = "key string, repaired_sha256 string"
        schema = to_arrow_schema(StructType.fromDDL(out))

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
            yield _table([[key, digest(r[1:] for r in found)] for key, found in groupby(rows, lambda r: r[0])], schema)

        return turns.repartition("key").sortWithinPartitions("key", "place").select("key", "role", "text").mapInArrow(digests, out)


def _parsed(ends: str) -> dict[int, dict[int, tuple[int, str]]]:
    found: dict[int, dict[int, tuple[int, str]]] = {state: {} for state in range(4)}
    for one in ends.split("|"):
        a, b, cost, audit = one.split(",")
        found[int(a)][int(b)] = int(cost), audit
    return found
