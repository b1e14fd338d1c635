"""Chat formatting with minimum-cost role repair: dynamic programming over an automaton of legal turns.

States are the role of the last turn: start, system, user, assistant. Legal: start to system or user, system to
user, user to assistant, assistant to user; a conversation ends after an assistant. Each message is kept or
relabelled, and either starts a turn, after inserted empty turns if need be, or is merged into the turn before.

Messages are dealt by ranges of (conversation, turn, role, text's hash), so that a task holds whole conversations but
for its first and last one, which neighbours may share. A conversation within one task and one block of messages is
solved there and then. The others are cut into blocks by position: each gives the least costs from any state before it
to any after it; these small matrices are chained per conversation; each block is then solved between its known
states. So a huge conversation spreads over tasks, whatever its turn numbers, and tasks hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Messages and text bytes from which a block is full; rows and text bytes of an output batch; longest remembered sequence of roles.
BLOCK_TURNS, BLOCK_BYTES, BATCH_ROWS, BATCH_BYTES, REMEMBERED = 4096, 8 << 20, 10_000, 8 << 20, 64
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
INFINITE = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    insert: int = 3
    relabel: int = 4
    relabel_unknown: int = 1


def _paths(costs: Costs) -> dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]:
    """(state, role) to (cost, inserted roles, merged) of the cheapest way to let a message of that role follow."""
    legal = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
    out: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {}
    for state in range(4):
        ways = {(): state}
        for _ in range(3):
            for inserted, at in sorted(ways.items()):
                for role in legal[at]:
                    cost = costs.insert * len(inserted)
                    if (state, role) not in out or cost < out[state, role][0]:
                        out[state, role] = cost, inserted, False
            ways = {(*inserted, role): role for inserted, at in ways.items() for role in legal[at]}
        if state != START and ((state, state) not in out or costs.merge <= out[state, state][0]):
            out[state, state] = costs.merge, (), True
    return out


def _role_of(name: str | None) -> int:
    """The state of a role's name, 0 for an unknown or missing one."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else START


class Automaton:
    def __init__(self, costs: Costs):
        self.costs, self.paths = costs, _paths(costs)
        #: From each role to each state after it, whatever the state before: (role, state, new role) to cost.
        self.step = [
            [[(self.paths[s, o][0] + self._relabel(r, o)) if (s, o) in self.paths else INFINITE for o in (SYSTEM, USER, ASSISTANT)] for s in range(4)] for r in range(4)
        ]
        self.closing = {ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}

    def _relabel(self, role: int, new: int) -> int:
        return 0 if role == new else self.costs.relabel if role else self.costs.relabel_unknown

    def forward(self, roles: list[int], before: list[int]) -> list[list[int]]:
        """Least costs of each state after each message, from costs of the states before the first."""
        out = [before]
        for r in roles:
            last, step = out[-1], self.step[r]
            out.append([INFINITE, *[min(last[s] + step[s][o] for s in range(4)) for o in range(3)]])
        return out

    def matrix(self, roles: list[int]) -> list[int]:
        """Costs from each state before to each state after, row by row; infinite where impossible."""
        return [min(INFINITE, c) for s in range(4) for c in self.forward(roles, [0 if t == s else INFINITE for t in range(4)])[-1]]

    def solve(self, roles: list[int], before: int, after: int) -> list[tuple[int, tuple[int, ...], bool]]:
        """(new role, inserted before it, merged) of each message on a cheapest way; ties go to the lower state."""
        costs = self.forward(roles, [0 if t == before else INFINITE for t in range(4)])
        state, out = after, []
        for i in range(len(roles) - 1, -1, -1):
            step = self.step[roles[i]]
            s = min(range(4), key=lambda s: (costs[i][s] + step[s][state - 1], s))  # noqa: B023
            out.append((state, *self.paths[s, state][1:]))
            state = s
        return out[::-1]

    def chain(self, matrices: list[list[int]]) -> list[tuple[int, int]]:
        """The states before and after each block on a cheapest way from the start to a legal end."""
        costs = [[0, INFINITE, INFINITE, INFINITE]]
        for m in matrices:
            costs.append([min(costs[-1][s] + m[4 * s + t] for s in range(4)) for t in range(4)])
        state = min((SYSTEM, USER, ASSISTANT), key=lambda t: (costs[-1][t] + self.costs.insert * len(self.closing[t]), -t))
        out = []
        for i in range(len(matrices) - 1, -1, -1):
            s = min(range(4), key=lambda s: (costs[i][s] + matrices[i][4 * s + state], s))  # noqa: B023
            out.append((s, state))
            state = s
        return out[::-1]


class Solver:
    """What becomes of messages, given their roles: all but their texts, remembered for short sequences."""

    def __init__(self, costs: Costs):
        self.auto = Automaton(costs)
        self.known: dict[tuple, list[tuple[str, str, str, str, str, str]]] = {}

    def block(self, roles: tuple[int, ...], before: int, after: int, last: bool) -> list[tuple[str, str, str, str, str, str]]:
        """(new role, action, inserted before, inserted after, what is rendered before and after the text) of each message."""
        key = (roles, before, after, last)
        if key in self.known:
            return self.known[key]
        names, empty = ("", *ROLES), lambda added: "".join(f"<|im_start|>{names[x]}\n<|im_end|>\n" for x in added)
        ways, out = self.auto.solve(list(roles), before, after), []
        for i, ((new, inserted, merged), role) in enumerate(zip(ways, roles, strict=True)):
            ends = last and i == len(ways) - 1
            closing = self.auto.closing[new] if ends else ()
            opened = "<|im_end|>\n" if before != START or i > 0 else ""
            head = "\n\n" if merged else f"{opened}{empty(inserted)}<|im_start|>{names[new]}\n"
            tail = f"<|im_end|>\n{empty(closing)}" if ends else ""
            action = "+".join([*(["relabel"] if role != new else []), *(["merge"] if merged else [])]) or "keep"
            out.append((names[new], action, ",".join(names[x] for x in inserted), ",".join(names[x] for x in closing), head, tail))
        if len(roles) <= REMEMBERED:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[key] = out
        return out

    def whole(self, roles: tuple[int, ...]) -> list[tuple[str, str, str, str, str, str]]:
        """The same for a whole conversation."""
        found = self.known.get((roles, START))
        if found is None:
            (before, after), = self.auto.chain([self.auto.matrix(list(roles))])
            found = self.block(roles, before, after, True)
            if len(roles) <= REMEMBERED:
                self.known[(roles, START)] = found
        return found


RESULT = {"conv_id": "long", "turn": "long", "role": "string", "new_role": "string", "action": "string", "inserted_before": "string", "inserted_after": "string", "rendered": "string"}
OPEN = {"part": "int", "block": "int", "place": "int", "matrix": "array<long>"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


class Rows:
    """Rows of these columns, gathered to batches of bounded size."""

    def __init__(self, columns: dict[str, str]):
        self.columns, self.rows, self.bytes = columns, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.bytes >= BATCH_BYTES

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, _ARROW[t]) for c, t in zip(zip(*self.rows, strict=True), self.columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=list(self.columns))
        self.rows, self.bytes = [], 0


def _messages(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for part in common.chunks(iter([batch]), "text"):
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def repair(conversations: DataFrame, costs: Costs = Costs(), block_turns: int = BLOCK_TURNS) -> DataFrame:  # noqa: B008
    """One row per message: conv_id, turn, role, new_role, action (keep, relabel, merge or relabel+merge),
    inserted_before (roles of empty turns), inserted_after (of those that end the conversation) and rendered, the
    message's part of the rendered conversation; the parts of a conversation, in the order of its messages, are the
    whole.

    Messages are ordered by turn, then role, then their text's hash; a null turn or role comes first, a null text is
    empty, a null or unknown role is relabelled, and messages without conv_id are a conversation of their own.
    Repeated rows are messages of their own. Texts may have any length. Extra columns are not read; an empty table
    gives an empty one."""
    keys = ["conv_id", "turn", "role", "hash", "tie"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Equal rows are told apart, so that ranges can divide them too; which is which makes no difference.
    dealt = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Solves what lies within the task; the blocks of the rest stay open, their first row with the matrix."""
        solver, out, part = Solver(costs), Rows(RESULT | OPEN), TaskContext.get().partitionId()
        held: list[tuple] = []
        size, blocks, current = 0, 0, None
        inner, cut = False, False  # whether the conversation is not the task's first; whether a block of it is out

        def close(solve: bool) -> None:
            nonlocal held, size, blocks
            roles = tuple(_role_of(m[2]) for m in held)
            if solve:
                for (conv, turn, role, text), (*done, head, tail) in zip(held, solver.whole(roles), strict=True):
                    out.add((conv, turn, role, *done, head + text + tail, None, None, None, None), len(text))
            else:
                matrix = solver.auto.matrix(list(roles))
                for i, (conv, turn, role, text) in enumerate(held):
                    out.add((conv, turn, role, None, None, None, None, text, part, blocks, i, None if i else matrix), len(text))
                blocks += 1
            held, size = [], 0

        for m in _messages(batches, ["conv_id", "turn", "role", "text"]):
            if held and m[0] != current:
                close(inner and not cut)
                inner, cut = True, False
            elif len(held) >= block_turns or size >= BLOCK_BYTES:
                close(False)
                cut = True
            current = m[0]
            held.append(m)
            size += len(m[3])
            if out.full():
                yield from out.batch()
        if held:
            close(False)
        yield from out.batch()

    made = common.materialise(dealt.select("conv_id", "turn", "role", "text").mapInArrow(first, _schema(RESULT | OPEN)), "roles")
    still_open = made.where("part is not null").select("conv_id", "turn", "role", F.col("rendered").alias("text"), *OPEN)

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = Automaton(costs)
        for pdf in batches:
            out = []
            for blocks in pdf["blocks"]:
                ways = auto.chain([list(b["matrix"]) for b in blocks])
                out += [(b["part"], b["block"], s, t, i == len(blocks) - 1) for i, (b, (s, t)) in enumerate(zip(blocks, ways, strict=True))]
            yield pd.DataFrame(out, columns=["part", "block", "before", "after", "last"])

    by_conversation = still_open.where("matrix is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", "matrix"))).alias("blocks"))
    states = by_conversation.mapInPandas(chained, "part int, block int, before int, after int, last boolean")
    joined = still_open.drop("matrix").join(states, ["part", "block"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Solves open blocks between their states."""
        solver, out, held, current = Solver(costs), Rows(RESULT), [], None

        def close() -> None:
            nonlocal held
            before, after, last = held[0][6:]
            for m, (*done, head, tail) in zip(held, solver.block(tuple(_role_of(m[4]) for m in held), before, after, last), strict=True):
                out.add((*m[2:5], *done, head + m[5] + tail), len(m[5]))
            held = []

        for m in _messages(batches, ["part", "block", "conv_id", "turn", "role", "text", "before", "after", "last"]):
            if held and m[:2] != current:
                close()
            current = m[:2]
            held.append(m)
            if out.full():
                yield from out.batch()
        if held:
            close()
        yield from out.batch()

    ordered = joined.repartition("part", "block").sortWithinPartitions("part", "block", "place")
    return made.where("part is null").select(*RESULT).unionByName(ordered.drop("place").mapInArrow(second, _schema(RESULT)))
