"""Conversation structure repair: a Viterbi search whose backpointer tree shrinks as its survivors coalesce.

A repaired conversation's role initials read ``(s?(ua)+)?``. A row is kept, gets another role or is
deleted, and a turn may be inserted before any row or at the end; the cheapest edits win, ties go to
the ASCII-least string of their initials. The search has four states (nothing yet, after s, after u,
after a). Every survivor is a leaf of a tree of backpointers with counts of their children; a leaf
that no state keeps is dropped with all that only it needed, and as long as the root has one child,
that child's edits are final, are handed on and freed. A survivor that another one undercuts by more
than it costs to go on in its stead can't win any more and is dropped too (else the one that has
deleted every row so far would keep the whole tree alive).

Ties: of two survivors the one with the lesser string of edits has the lower rank. Inserted turns
belong to the row that follows them, so all strings of one place have as many row edits, none is the
beginning of another, and two states never share one. Comparing two candidates is therefore comparing
the ranks of the survivors that they extend, which stands for comparing their complete unresolved
suffixes; the rank is handed down with every step.

Rows stream through tasks in order. A conversation with very many rows is dealt to pieces by range, and
each piece tells, for each state before it, the least cost and the order of the edits up to each
state after it. These 4 x 4 tables are put together conversation by conversation (few numbers a piece),
after which every piece is searched once more between its two known states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

INF = float("inf")
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: States: nothing yet, after s, after u, after a. What the user's and the assistant's turn lead to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "s": {NOTHING: SYSTEM}}
#: What each state still needs at the end.
CLOSING = {NOTHING: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What it costs, at most, to go on from the first state as any path goes on from the second: delete the
#: system's turn that only NOTHING may keep, insert the turn that is missing, close what isn't closed.
IMITATES = {
    (ASSISTANT, NOTHING): 2, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 5,
    (USER, NOTHING): 7, (USER, SYSTEM): 5, (USER, ASSISTANT): 5,
    (SYSTEM, NOTHING): 12, (SYSTEM, USER): 5, (SYSTEM, ASSISTANT): 10,
    (NOTHING, SYSTEM): 0, (NOTHING, USER): 5, (NOTHING, ASSISTANT): 0,
}


def turn_after(state: int) -> int:
    """The state after an inserted or re-roled turn: the one turn that may follow and isn't the system's."""
    return ASSISTANT if state == USER else USER


def steps(initial: str, doomed: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of a row: for two states the cheapest, then least edits."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED_COST * truncated
    for before, inserted in product(range(4), (False, True)):
        # a second insertion before a row never pays: two turns lead back to where one row leads anyway
        state, cost, edits = (turn_after(before), COSTS[INSERT], INSERT) if inserted else (before, 0, "")
        found = [(state, COSTS[DELETE], DELETE)]
        if not doomed:
            found.append((turn_after(state), COSTS[REROLE] + extra, REROLE))
            if state in NEXT.get(initial, ()):
                found.append((NEXT[initial][state], COSTS[KEEP] + extra, KEEP))
        for after, own, edit in found:
            trial = (cost + own, edits + edit)
            best[before, after] = min(best.get((before, after), trial), trial)
    return [(before, after, cost, edits) for (before, after), (cost, edits) in sorted(best.items())]


STEPS = {(initial, doomed, truncated): steps(initial, doomed, truncated) for initial in ("s", "u", "a", "") for doomed in (False, True) for truncated in (False, True)}


def steps_of(role: str, fault: str) -> list[tuple[int, int, int, str]]:
    initial = role[:1]
    return STEPS[initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"]


def advance(cost: list[float], rank: list[int], moves: list[tuple[int, int, int, str]]) -> tuple[list[float], list[int], list[tuple[int, str] | None]]:
    """One row further: (costs, ranks, (state before, edits)) of the four survivors; rank orders complete strings."""
    best: list[tuple | None] = [None] * 4
    for before, after, own, edits in moves:
        if cost[before] < INF:
            trial = (cost[before] + own, rank[before], edits, before)
            if best[after] is None or trial < best[after]:
                best[after] = trial
    order = {key: i for i, key in enumerate(sorted((x[1], x[2]) for x in best if x))}
    return (
        [x[0] if x else INF for x in best],
        [order[x[1], x[2]] if x else 0 for x in best],
        [(x[3], x[2]) if x else None for x in best],
    )


class Node:
    """A backpointer: the edits of one row, and how many nodes or survivors lean on it."""

    __slots__ = ("before", "edits", "row", "state", "uses", "child")

    def __init__(self, before, edits, row, state):
        self.before, self.edits, self.row, self.state, self.uses, self.child = before, edits, row, state, 0, None


class Survivors:
    """The search over one conversation, or one piece of it from a known state; hands on (row, edits, state before) as they become final."""

    def __init__(self, entry: int, emit: Callable[[object, str, int], None]):
        self.emit, self.size, self.largest = emit, 0, 0
        self.root = Node(None, "", None, entry)
        self.root.uses = 1
        self.cost, self.rank, self.leaf = [INF] * 4, [0] * 4, [None] * 4
        self.cost[entry], self.leaf[entry] = 0, self.root

    def push(self, row, moves: list[tuple[int, int, int, str]]) -> None:
        self.cost, self.rank, found = advance(self.cost, self.rank, moves)
        for (one, other), most in IMITATES.items():
            if INF > self.cost[other] > self.cost[one] + most:
                self.cost[other], found[other] = INF, None
        old, self.leaf = self.leaf, [None] * 4
        for state, own in enumerate(found):
            if own:
                parent = old[own[0]]
                parent.uses += 1
                parent.child = node = Node(parent, own[1], row, state)
                node.uses = 1
                self.leaf[state] = node
                self.size += 1
        for node in old:
            self._release(node)
        self.largest = max(self.largest, self.size)
        self._settle()

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.uses -= 1
            if node.uses or node is self.root:
                return
            parent = node.before
            if parent.child is node:
                parent.child = None
            self.size -= 1
            node = parent

    def _settle(self) -> None:
        """While all survivors share the root's only child, it is final."""
        while self.root.uses == 1 and not any(leaf is self.root for leaf in self.leaf):
            child = self.root.child or self._only_child()
            self.emit(child.row, child.edits, self.root.state)
            child.before = None
            self.root = child
            self.size -= 1

    def _only_child(self) -> Node:
        node = next(leaf for leaf in self.leaf if leaf is not None)
        while node.before is not self.root:
            node = node.before
        return node

    def finish(self, state: int | None = None) -> str:
        """Ends in ``state``, or in the best one, and hands on what is left; returns the closing edits."""
        closing = ""
        if state is None:
            ends = [(self.cost[s] + COSTS[INSERT] * len(CLOSING[s]), self.rank[s], s) for s in range(4) if self.leaf[s] is not None]
            state = min(ends)[2]
            closing = CLOSING[state]
        for s in range(4):
            if s != state:
                leaf, self.leaf[s] = self.leaf[s], None
                self._release(leaf)
        self._settle()
        return closing


def fault_of(role: str, text: str, seen: set[bytes]) -> str:
    """The first fault of a row; ``seen`` holds 128-bit digests of the roles and texts before it."""
    key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
    known = key in seen
    seen.add(key)
    bare = text.rstrip(BLANKS)
    return "blank" if not bare else "duplicate" if known else "" if bare[-1] in ".!?" else "truncated"


# ---- rows in tasks ----

EDITS = "conv_id {id}, piece int, at bigint, turn bigint, role string, text string, fault string, edit string, new_role string, cost bigint"
ORDER = ["conv_id", "piece", "turn", "role", "text"]


class Rows:
    """Collects output rows and gives them out as Arrow batches."""

    def __init__(self, names: list[str], types: list[pa.DataType], most_chars: int = 1 << 21):
        self.names, self.types, self.most, self.rows, self.chars = names, types, most_chars, [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += 64 + sum(len(x) for x in row if isinstance(x, str))

    def full(self) -> bool:
        return self.chars >= self.most

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.names)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], self.names)


def _listed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _searched(id_type: pa.DataType):
    """Rows in order of conversation, piece and turn, each piece with its state before and, if it isn't the last, after."""
    names = ["conv_id", "piece", "at", "turn", "role", "text", "fault", "edit", "new_role", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(names, [id_type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()])
        now = search = None
        seen: set[bytes] = set()
        at = [0]

        def put(row, edits: str, state: int) -> None:
            conv, piece = now[:2]
            for edit in edits:
                place = at[0]
                at[0] += 1
                if edit == INSERT:
                    state = turn_after(state)
                    out.add(conv, piece, place, None, None, "", None, edit, ROLES[state], COSTS[edit])
                    continue
                turn, role, text, fault = row
                new = None
                if edit == REROLE:
                    state = turn_after(state)
                    new = ROLES[state]
                elif edit == KEEP:
                    state, new = NEXT[role[:1]][state], role
                out.add(conv, piece, place, turn, role, text, fault, edit, new, COSTS[edit] + TRUNCATED_COST * (fault == "truncated" and edit != DELETE))

        def close() -> None:
            if search is not None:
                closing = search.finish(now[3])
                put(None, closing, search.root.state)

        for conv, piece, turn, role, text, before, entry, leave in _listed(batches, [*ORDER, "seen_before", "entry", "leave"]):
            if now is None or (conv, piece) != now[:2]:
                close()
                now, at[0] = (conv, piece, entry, leave), 0
                seen.clear()
                search = Survivors(entry, put)
            fault = fault_of(role, text, seen)
            fault = "duplicate" if before and fault != "blank" else fault
            search.push((turn, role, text, fault), steps_of(role, fault))
            if out.full():
                yield out.take()
        close()
        if out.rows:
            yield out.take()

    return run


def _tables(id_type: pa.DataType):
    """One row a piece: for each state before it the costs and ranks of the states after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(["conv_id", "piece", "costs", "ranks"], [id_type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32())])
        now, found, seen = None, [], set()

        def close() -> None:
            if now is not None:
                out.add(*now, [c for cost, _ in found for c in cost], [r for _, rank in found for r in rank])

        for conv, piece, role, text, before in _listed(batches, ["conv_id", "piece", "role", "text", "seen_before"]):
            if now != (conv, piece):
                close()
                now = (conv, piece)
                seen.clear()
                found = [([0.0 if s == e else INF for s in range(4)], [0] * 4) for e in range(4)]
            fault = fault_of(role, text, seen)
            moves = steps_of(role, "duplicate" if before and fault != "blank" else fault)
            found = [advance(cost, rank, moves)[:2] for cost, rank in found]
        close()
        if out.rows:
            yield out.take()

    return run


def through(pieces: list[tuple[list[float], list[int]]]) -> list[tuple[int, int | None]]:
    """(state before, state after) of each piece of one conversation from its 4 x 4 tables; the last piece's end is free."""
    cost, rank, back = [0.0, INF, INF, INF], [0] * 4, []
    for costs, ranks in pieces:
        best: list[tuple | None] = [None] * 4
        for before, after in product(range(4), range(4)):
            if cost[before] + costs[4 * before + after] < INF:
                trial = (cost[before] + costs[4 * before + after], rank[before], ranks[4 * before + after], before)
                if best[after] is None or trial < best[after]:
                    best[after] = trial
        order = {key: i for i, key in enumerate(sorted(x[1:3] for x in best if x))}
        cost, rank = [x[0] if x else INF for x in best], [order[x[1:3]] if x else 0 for x in best]
        back.append([x[3] if x else None for x in best])
    state = min((cost[s] + COSTS[INSERT] * len(CLOSING[s]), rank[s], s) for s in range(4) if cost[s] < INF)[2]
    found: list[tuple[int, int | None]] = []
    for place, before in enumerate(reversed(back)):
        found.append((before[state], state if place else None))
        state = before[state]
    return found[::-1]


def _joined(id_type: pa.DataType):
    """Pieces' tables in order of conversation and piece: each piece's states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(["of", "part", "entry", "leave"], [id_type, pa.int32(), pa.int32(), pa.int32()])
        now, numbers, pieces = None, [], []

        def close() -> None:
            for number, states in zip(numbers, through(pieces) if pieces else [], strict=True):
                out.add(now[0], number, *states)

        for conv, piece, costs, ranks in _listed(batches, ["conv_id", "piece", "costs", "ranks"]):
            if now != (conv,):
                close()
                now, numbers, pieces = (conv,), [], []
            numbers.append(piece)
            pieces.append((costs, ranks))
        close()
        if out.rows:
            yield out.take()

    return run


def repair(conversations: DataFrame, piece_rows: int = 100_000, most_long: int = 10_000) -> DataFrame:
    """One row an edit, in the order of ``at`` within (conv_id, piece): turn, role, text, fault, edit, new_role, cost.

    ``edit`` is K, R, D or I (kept, re-roled, deleted, inserted); ``new_role`` is null for deleted rows,
    ``fault`` is blank, duplicate, truncated or empty, and null, as turn and role, for inserted turns.
    Rows of a conversation go by turn (nulls first), then by role and text in byte order, so repeated
    rows lie next to each other and all but the first are duplicates. Null roles and texts count as
    one space, null ids are one conversation; other columns play no part, and an empty table gives no
    rows.

    A conversation is long with ``piece_rows`` rows, or one row in ``most_long`` of all if that is more: so
    at most ``most_long`` are long, which bounds what is broadcast.
    """
    id_type = conversations.schema["conv_id"].dataType
    name = id_type.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(name)
    if arrow is None:
        raise ValueError("conv_id is a bigint, an int or a string")
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "conversations")
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text")
    )
    counts = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("rows"))
    total = rows.count()
    long = scratch.save(counts.filter(F.col("rows") >= max(piece_rows, -(-total // most_long))).select("long_id", F.lit(True).alias("long")), "long")
    n_long = long.count()
    free = [F.lit(0).alias("piece"), F.lit(False).alias("seen_before"), F.lit(NOTHING).alias("entry"), F.lit(None).cast("int").alias("leave")]
    columns = [*ORDER, "seen_before", "entry", "leave"]
    if not n_long:
        dealt = rows.select("*", *free).select(columns)
    else:
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        short = rows.join(F.broadcast(long), same, "left_anti").select("*", *free).select(columns)  # most_long ids at most
        own = rows.join(F.broadcast(long), same).drop("long_id", "long")
        ranges = max(2, -(-total // piece_rows))
        pieces = scratch.save(own.repartitionByRange(ranges, "conv_id", "turn", "role", "text").withColumn("piece", F.spark_partition_id()), "pieces")
        digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("digest")
        first = pieces.select(F.col("conv_id").alias("of"), digest.alias("of_digest"), "piece").groupBy("of", "of_digest").agg(F.min("piece").alias("first"), F.max("piece").alias("last"))
        first = scratch.save(first.filter(F.col("first") < F.col("last")).drop("last"), "first")
        marked = pieces.select("*", digest).join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
        marked = scratch.save(marked.select(*ORDER, F.coalesce(F.col("first") < F.col("piece"), F.lit(False)).alias("seen_before")), "marked")
        spread = marked.repartition("conv_id", "piece").sortWithinPartitions(*ORDER)
        tables = spread.mapInArrow(_tables(arrow), f"conv_id {name}, piece int, costs array<double>, ranks array<int>")
        states = scratch.save(tables.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_joined(arrow), f"of {name}, part int, entry int, leave int"), "states")
        held = F.broadcast(states)  # a row a piece: as many as ranges and long conversations together
        many = marked.join(held, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("part"))).select(columns)
        dealt = short.unionByName(many)
    return dealt.repartition("conv_id", "piece").sortWithinPartitions(*ORDER).mapInArrow(_searched(arrow), EDITS.format(id=name))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def _digested(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["of", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        out = Rows(names, [id_type, *[pa.int64()] * 6, pa.string(), pa.string()])
        now = None

        def close() -> None:
            if now is not None:
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
                out.add(now[0], min(gaps, 2**63 - 1), *faults, illegal, cost, "".join(audit), digest.hexdigest())

        for conv, turn, role, text, fault, edit, new_role, own in _listed(batches, ["conv_id", "turn", "role", "text", "fault", "edit", "new_role", "cost"]):
            if now != (conv,):
                close()
                now, turns, faults, illegal, cost, audit, digest, initial, lines = (conv,), None, [0, 0, 0], 0, 0, [], hashlib.sha256(), None, 0
            audit.append(edit)
            cost += own
            if edit != INSERT:
                if turn is not None:
                    turns = [turn, turn, 1] if turns is None else [turns[0], turn, turns[2] + (turn != turns[1])]
                if fault:
                    faults[("blank", "duplicate", "truncated").index(fault)] += 1
                illegal += initial is not None and initial + role[:1] not in ("su", "ua", "au")
                initial = role[:1]
            if edit != DELETE:
                digest.update(f"{chr(10) if lines else ''}{new_role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1
            if out.full():
                yield out.take()
        close()
        if out.rows:
            yield out.take()

    return run


def digests(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """The rows of op13: one for each conv_id of ``conversations``, from the edits of its rows.

    A conversation's edits stream in order through one digest; only its counts and the edits' initials
    are held.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at")
    found = ordered.mapInArrow(_digested(arrow), f"of {id_type}, " + ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) + ", audit string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def brute_force(rows: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """For tests: (cost, audit, repaired text) of (role, text, fault) rows, by trying every string of edits."""
    best = None

    def closed(initials: str) -> bool:
        rest = initials[1:] if initials[:1] == "s" else initials
        return initials == "" or len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)

    def ahead(i: int, cost: int, audit: str, out: list[tuple[str, str]], inserted: int) -> None:
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(role[:1] or "?" for role, _ in out)
        if not any(("s" * s + "ua" * (len(out) + 1))[: len(out)] == initials for s in (0, 1)):
            return
        if i == len(rows) and closed(initials):
            trial = (cost, audit, "\n".join(f"{role}:{text}" for role, text in out))
            best = trial if best is None else min(best, trial)
        if inserted < 2:
            for role in ("user", "assistant"):
                ahead(i, cost + 5, audit + "I", [*out, (role, "")], inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        ahead(i + 1, cost + 2, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            ahead(i + 1, cost + extra, audit + "K", [*out, (role, text)], 0)
            for new in ("user", "assistant"):
                ahead(i + 1, cost + 1 + extra, audit + "R", [*out, (new, text)], 0)

    ahead(0, 0, "", [], 0)
    return best
