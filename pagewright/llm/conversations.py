"""Repair of conversations: the cheapest edits that make the roles of a conversation follow ``(s?(ua)+)?``.

Turns are kept (cost 0), given another role (3) or deleted (4), and empty turns are inserted anywhere (3). Blank turns and repeats have to go; a truncated turn
that stays costs 3 more. The method is a backward dynamic program over turns and grammar states (what the cheapest edits from here to the end cost), and then a forward
walk that takes the ASCII-least edit among those whose cost is tight, so that of all cheapest edits the least word of initials (D, I, K, R) is found.

How it runs: turns are dealt out by conversation, once. Two sorted passes over Arrow batches follow in the same partitions, backward and forward. What a pass knows is one
small vector: costs to go differ by a bounded amount between states, so that only their differences are kept, packed in a long beside the turn, and transitions
are remembered by vector and kind of turn. A conversation of any length streams through with the memory of a batch; the digest of a whole conversation
is sequential by its nature, so one conversation is one task's.

Defined results: a null conversation id is a conversation of its own. Turns stand by turn (null first), then role and text, so that rows of one turn have a fixed
order. A null role or text is one space. A role is known by its first character, case as it is; only a role that is kept, or dropped, may be other than user or assistant. Repeated rows
are duplicates. A conversation without turns has none after repair. An empty table gives no rows. Columns beyond the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import give_back, let_workers_import

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant. What an initial leads to from each.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
#: The one role that an edit may give in each state.
_GIVEN = {_START: "user", _SYSTEM: "user", _USER: "assistant", _ASSISTANT: "user"}
_SPACES = " \t\n\x0b\x0c\r"
#: What faults mean to the program.
_SOUND, _GOES, _CUT = range(3)


def _given(state: int) -> tuple[str, int]:
    role = _GIVEN[state]
    return role, _NEXT[state][role[0]]


def _with_inserts(costs: list[float]) -> tuple[int, ...]:
    """Costs to go where turns may be inserted first: two rounds reach every state, as a third insert would come back to a state that was left."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_given(s)[1]]) for s, c in enumerate(costs)]
    return tuple(int(c) for c in costs)


_END = _with_inserts([0, float("inf"), float("inf"), 0])


def _edits(after: tuple[int, ...], initial: str, kind: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that take a turn in this state: letter, cost to the end, next state."""
    found = [("D", DELETE + after[state], state)]
    if kind != _GOES:
        more = TRUNCATED if kind == _CUT else 0
        if initial in _NEXT[state]:
            found.append(("K", KEEP + more + after[_NEXT[state][initial]], _NEXT[state][initial]))
        found.append(("R", REROLE + more + after[_given(state)[1]], _given(state)[1]))
    return found


@lru_cache(100_000)
def _before(after: tuple[int, ...], initial: str, kind: int) -> tuple[tuple[int, ...], int]:
    """Costs to go before a turn, less the least of them, and that least."""
    costs = _with_inserts([min(cost for _, cost, _ in _edits(after, initial, kind, s)) for s in range(4)])
    return tuple(c - min(costs) for c in costs), min(costs)


@lru_cache(100_000)
def _walk(after: tuple[int, ...], initial: str, kind: int, state: int) -> tuple[tuple[tuple[str, str | None], ...], int, int]:
    """From a state over a turn by ASCII-least tight edits: (letter, role given), the next state, and what the edits cost."""
    (costs, least), steps, paid = _before(after, initial, kind), [], 0
    while True:
        tight = costs[state] + least
        takes = {letter: to for letter, cost, to in _edits(after, initial, kind, state) if cost == tight}
        role, to = _given(state)
        if "D" not in takes and INSERT + costs[to] + least == tight:
            steps.append(("I", role))
            state, paid = to, paid + INSERT
            continue
        letter = min(takes)
        paid += tight - after[takes[letter]]
        steps.append((letter, role if letter == "R" else None))
        return tuple(steps), takes[letter], paid


def _finish(state: int) -> list[str]:
    """Roles to insert at a conversation's end."""
    roles = []
    while state in (_SYSTEM, _USER):
        role, state = _given(state)
        roles.append(role)
    return roles


def _packed(costs: tuple[int, ...]) -> int:
    return sum(c << (8 * i) for i, c in enumerate(costs))


@lru_cache(100_000)
def _unpacked(costs: int) -> tuple[int, ...]:
    return tuple(costs >> (8 * i) & 255 for i in range(4))


def blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES)) == ""


def truncated(text: Column) -> Column:
    """The last character that isn't white space ends no sentence."""
    return ~F.right(F.rtrim(text, F.lit(_SPACES)), F.lit(1)).isin(".", "!", "?")


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, with one space for a null role or text."""
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds fault, the first that holds of blank, duplicate (role and text stood in the conversation before) and truncated, else null. The rows are dealt out by conversation."""
    alike = F.struct("role", F.sha2("text", 256).alias("digest"))
    before = F.lag("alike").over(W.partitionBy("conv_id").orderBy("alike", F.asc_nulls_first("turn")))  # by conversation alone, as the passes that follow need it
    seen = turns.withColumn("alike", alike).withColumn("seen", F.coalesce(before == F.col("alike"), F.lit(False)))
    fault = F.when(blank(F.col("text")), "blank").when(F.col("seen"), "duplicate").when(truncated(F.col("text")), "truncated")
    return seen.select(*turns.columns, fault.alias("fault"))


_KINDS = {None: _SOUND, "truncated": _CUT, "blank": _GOES, "duplicate": _GOES}


def _light(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(conversation, initial of the role, kind) per row."""
    ids = batch.column(batch.schema.get_field_index("conv_id")).to_pylist()
    initials = pc.utf8_slice_codeunits(batch.column(batch.schema.get_field_index("role")), 0, 1).to_pylist()
    faults = batch.column(batch.schema.get_field_index("fault")).to_pylist()
    return zip(ids, initials, (_KINDS[f] for f in faults), strict=True)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from its end: adds what edits cost after a row, by state, less the least."""
    conv, costs = object(), _END
    for batch in batches:
        packed = []
        for own, initial, kind in _light(batch):
            if own != conv:
                conv, costs = own, _END
            packed.append(_packed(costs))
            costs, _ = _before(costs, initial if initial in ("s", "u", "a") else "", kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.int64())], names=[*batch.schema.names, "after"])
    give_back()


_EDIT = "conv_id {id}, position long, edit string, turn {turn}, role string, text string, fault string, was string, cost long"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation in order, with what edits cost after them, to one row per edit."""
    conv, state, position, none = object(), _START, 0, True
    kinds: tuple[pa.DataType, pa.DataType] | None = None

    def made(ids: list, letters: list, roles: list, costs: list, places: list, batch: pa.RecordBatch | None) -> pa.RecordBatch:
        n = len(ids)
        at = pa.array(places, pa.int32())
        own = {c: batch.column(batch.schema.get_field_index(c)).take(at) if batch is not None else pa.nulls(n, kind) for c, kind in (("turn", kinds[1]), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()))}
        given = pc.coalesce(pa.array(roles, pa.string()), own["role"])
        columns = [pa.array(ids, kinds[0]), pa.array([p for p, _ in letters], pa.int64()), pa.array([x for _, x in letters]), own["turn"], given, pc.coalesce(own["text"], pa.scalar("")), own["fault"], own["role"], pa.array(costs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "position", "edit", "turn", "role", "text", "fault", "was", "cost"])

    for batch in batches:
        kinds = batch.schema.field("conv_id").type, batch.schema.field("turn").type
        ids, letters, roles, costs, places = [], [], [], [], []

        def add(letter: str, role: str | None, cost: int, place: int | None) -> None:
            nonlocal position
            ids.append(conv)
            letters.append((position, letter))
            roles.append(role)
            costs.append(cost)
            places.append(place)
            position += 1

        after = batch.column(batch.schema.get_field_index("after")).to_pylist()
        for i, ((own, initial, kind), packed) in enumerate(zip(_light(batch), after, strict=True)):
            if own != conv or none:
                for role in () if none else _finish(state):
                    add("I", role, INSERT, None)
                conv, state, position, none = own, _START, 0, False
            steps, state, paid = _walk(_unpacked(packed), initial if initial in ("s", "u", "a") else "", kind, state)
            for letter, role in steps[:-1]:
                add(letter, role, INSERT, None)
            add(*steps[-1], paid - INSERT * (len(steps) - 1), i)
        yield made(ids, letters, roles, costs, places, batch)
    rest = [] if none else _finish(state)
    if rest:
        yield made([conv] * len(rest), [(position + i, "I") for i in range(len(rest))], rest, [INSERT] * len(rest), [None] * len(rest), None)
    give_back()


def _types(turns: DataFrame) -> dict[str, str]:
    return {"id": turns.schema["conv_id"].dataType.simpleString(), "turn": turns.schema["turn"].dataType.simpleString()}


def _prepared(turns: DataFrame) -> DataFrame:
    """Turns with faults and costs to go, in order within partitions that hold conversations whole."""
    let_workers_import(turns.sparkSession)
    rows = with_faults(turns)
    schema = f"conv_id {_types(turns)['id']}, turn {_types(turns)['turn']}, role string, text string, fault string, after long"
    repeats = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # after the row of the same turn that it repeats
    back = rows.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc(repeats)).mapInArrow(_backward, schema)
    return back.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", repeats)


def edits(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text, as ``turns_of`` gives them. One row per edit, at its position: its letter, the turn's number (null for an insert), role and text after it,
    the turn's fault, the role it had, and what the edit cost."""
    return _prepared(turns).mapInArrow(_forward, _EDIT.format(**_types(turns)))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the conversations after repair."""
    return edits(turns).where(F.col("edit") != "D").select("conv_id", "position", "role", "text")


_REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Report:
    """What is known of a conversation while its edits pass by."""

    def __init__(self) -> None:
        self.least = self.last = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def add(self, edit: str, turn: int | None, role: str, text: str, fault: str | None, was: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "D":
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least, self.last = turn if self.least is None else self.least, turn
        if self.initial is not None and (self.initial, was[:1]) not in _LEGAL:
            self.illegal += 1
        self.initial = was[:1]

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to one row per conversation."""
    conv, report, kind = None, None, None
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def made(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names=["conv_id", *names])

    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        wanted = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "edit", "turn", "role", "text", "fault", "was", "cost"))
        for own, *values in zip(*wanted, strict=True):
            if report is None or own != conv:
                if report:
                    done.append((conv, *report.row()))
                conv, report = own, _Report()
            report.add(*values)
        if done:
            yield made(done)
    if report:
        yield made([(conv, *report.row())])


def _in_turn(*steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def reports(turns: DataFrame) -> DataFrame:
    """One row per conversation that has turns: gaps in its turns, faults, adjacent roles out of order, what the edits cost, their letters, and the
    digest of the repaired ``role:text`` lines."""
    return _prepared(turns).mapInArrow(_in_turn(_forward, _reports), _REPORT.format(**_types(turns)))


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    draw = F.col("draw")
    text = F.when(draw == 1, "").when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.withColumn("draw", F.crc32(name) % 20).where(draw != 0)
    return rows.withColumn("draw", F.explode(F.when(draw == 3, F.array(draw, draw)).otherwise(F.array(draw)))).select("conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report on every conversation after damage; one that lost all its turns has zeros and the digest of nothing."""
    turns = turns_of(conversations)
    found = reports(damaged(turns)).withColumnRenamed("conv_id", "own")
    every = turns.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return whole.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
