"""Chat formatting: minimum-cost repair of roles, then rendering.

The legal turns of a conversation are an optional system turn, then user and assistant by turns,
the last of them the assistant's. Each row keeps its role or is relabelled, and either opens a
turn or merges into the one before; empty turns may be inserted before a turn or at the end. The
automaton's states are the role of the turn that is open; dynamic programming finds the repair
with the least sum of costs: MERGE, INSERT for each empty turn, RELABEL. Of equal repairs, the
one whose states are least from the last row backwards is taken.

A conversation may hold any share of all rows, so rows are dealt by ranges of (conversation,
turn) and kept in the shared folder; no conversation has to be in one task. A partition reduces
its piece of a conversation that goes on elsewhere to the least costs from each state before it
to each after it, a 4 by 3 matrix, and these alone, at most two of each partition, meet on the
driver. In a second pass such a piece gives, for each state after it, the state before it; in the
third all rows are written.

The result has a row for each input row: conv_id, turn, role, new_role, action (keep, relabel, merge, relabel and merge),
inserted (roles of the empty turns before it), appended (roles of empty turns after the last
row), cost, and rendered, its part of the text: joined in order, these are the conversation.

Defined cases: a null or unknown role must be relabelled. A null text is rendered as an empty
one. Turns of equal number are in the order of role and text. Rows with a null conversation are
one conversation. No rows: no result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from walkgraph.llm.common import checkpointed, partitions

ROLES = ("system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3
BEGIN = 3
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
FAR = 1 << 60

#: Empty turns that have to stand between an open turn (or the beginning) and a new turn.
BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (BEGIN, 0): (), (BEGIN, 1): (), (BEGIN, 2): (1,),
    (0, 1): (), (0, 2): (1,),
    (1, 1): (2,), (1, 2): (),
    (2, 1): (), (2, 2): (1,),
}
#: Empty turns after the last row.
AFTER: dict[int, tuple[int, ...]] = {0: (1, 2), 1: (2,), 2: ()}


def moves(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(state before, state after, cost, whether it merges) for a row of this role, the cheapest of each pair."""
    out = []
    for to in range(3):
        own = 0 if role == ROLES[to] else RELABEL
        for before in range(4):
            ways = [(INSERT * len(BETWEEN[before, to]), False)] if (before, to) in BETWEEN else []
            if before == to:
                ways.append((MERGE, True))
            if ways:
                cost, merges = min(ways)
                out.append((before, to, own + cost, merges))
    return out


MOVES = {r: moves(r) for r in (*ROLES, None)}


def forward(costs: list[int], roles: list[str | None]) -> tuple[list[int], list[list[int]]]:
    """Least costs after the rows, and for each row and state after it the least state before it that gives them."""
    back = []
    for role in roles:
        now, prior = [FAR] * 4, [-1] * 3
        for before, to, cost, _ in MOVES.get(role, MOVES[None]):
            c = costs[before] + cost
            if c < now[to] or (c == now[to] and before < prior[to]):
                now[to], prior[to] = c, before
        costs = now
        back.append(prior)
    return costs, back


def start_costs(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def best_end(costs: list[int]) -> int:
    return min(range(3), key=lambda s: (costs[s] + INSERT * len(AFTER[s]), s))


def states_back(back: list[list[int]], end: int) -> tuple[int, list[int]]:
    """The state before the first row, and the state after each."""
    states = [end]
    for prior in reversed(back):
        states.append(prior[states[-1]])
    states.reverse()
    return states[0], states[1:]


def written_rows(conv, rows: list[dict], before: int, states: list[int], last: bool) -> Iterator[tuple]:
    for i, (row, to) in enumerate(zip(rows, states)):
        _, _, cost, merges = next(m for m in MOVES.get(row["role"], MOVES[None]) if m[0] == before and m[1] == to)
        inserted = () if merges else BETWEEN[before, to]
        tail = AFTER[to] if last and i == len(rows) - 1 else ()
        text = "\n" if merges else ("" if before == BEGIN else CLOSE)
        text += "".join(f"{OPEN}{ROLES[r]}\n{CLOSE}" for r in inserted)
        text += ("" if merges else f"{OPEN}{ROLES[to]}\n") + (row["text"] or "")
        if last and i == len(rows) - 1:
            text += CLOSE + "".join(f"{OPEN}{ROLES[r]}\n{CLOSE}" for r in tail)
        action = " and ".join([*["relabel"] * (row["role"] != ROLES[to]), *["merge"] * merges]) or "keep"
        yield (conv, row["turn"], row["role"], ROLES[to], action, [ROLES[r] for r in inserted], [ROLES[r] for r in tail], cost + INSERT * len(tail), text)
        before = to


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, list[dict]]]:
    """A partition's rows by conversation: (conv_id, whether it is the partition's first, rows)."""
    first, have, name = True, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if have is None or row["conv"] != name:
                if have is not None:
                    yield name, first, have
                    first = False
                name, have = row["conv"], []
            have.append(row)
    if have is not None:
        yield name, first, have


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each row, as the module says."""
    n = partitions(turns.sparkSession)
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind, of_turn = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    order = ["conv", "turn", "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = checkpointed(rows.drop("tie")).withColumn("pid", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))

    ends = rows.groupBy("pid").agg(F.min_by("conv", F.struct(F.col("conv").isNotNull(), "conv")).alias("a"), F.max_by("conv", F.struct(F.col("conv").isNotNull(), "conv")).alias("b")).orderBy("pid").collect()
    # Conversations that go on from one partition into the next: (pid, first or last piece) in order.
    chains: list[list[int]] = []
    for here, there in zip(ends, ends[1:]):
        if here["b"] == there["a"]:
            if chains and chains[-1][-1] == here["pid"] and here["a"] == here["b"]:
                chains[-1].append(there["pid"])
            else:
                chains.append([here["pid"], there["pid"]])
    of = {r["pid"]: r for r in ends}
    shared = {(p, of[c[0]]["b"]) for c in chains for p in c}
    pids = sorted({p for p, _ in shared})

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, pid = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["pid"], r["conv"]) not in shared:
                    continue
                if pid != (r["pid"], r["conv"]):
                    if pid is not None:
                        yield _matrix(pid, costs)
                    pid, costs = (r["pid"], r["conv"]), [start_costs(s) for s in range(4)]
                costs = [forward(c, [r["role"]])[0] for c in costs]
        if pid is not None:
            yield _matrix(pid, costs)

    def _matrix(at: tuple, costs: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"pid": at[0], "conv": at[1], "costs": [x for c in costs for x in c]}], pa.schema([("pid", pa.int32()), ("conv", arrow), ("costs", pa.list_(pa.int64()))]))

    arrow = to_arrow_type(rows.schema["conv"].dataType)
    before: dict[tuple, list[int]] = {}
    starts: dict[tuple, int] = {}
    finals: dict[tuple, tuple[int, bool]] = {}
    if chains:
        some = rows.where(F.col("pid").isin(pids)).select("pid", "conv", "role")
        matrix = {(r["pid"], r["conv"]): [r["costs"][4 * s : 4 * s + 4] for s in range(4)] for r in some.mapInArrow(reduced, f"pid int, conv {kind}, costs array<bigint>").collect()}
        after: dict[tuple, list[int]] = {}
        for chain in chains:
            costs = start_costs(BEGIN)
            for p in chain:
                at = (p, of[chain[0]]["b"])
                before[at] = costs
                costs = [min(min(costs[s] + matrix[at][s][e] for s in range(4)), FAR) for e in range(3)] + [FAR]
            after[at] = costs

        def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, _, have in pieces(batches):
                if (at := (have[0]["pid"], name)) in shared:
                    _, back = forward(before[at], [r["role"] for r in have])
                    maps = [states_back(back, e)[0] for e in range(3)]
                    yield pa.RecordBatch.from_pylist([{"pid": at[0], "conv": name, "maps": maps}], pa.schema([("pid", pa.int32()), ("conv", arrow), ("maps", pa.list_(pa.int32()))]))

        maps = {(r["pid"], r["conv"]): r["maps"] for r in some.mapInArrow(traced, f"pid int, conv {kind}, maps array<int>").collect()}
        for chain in chains:
            name, last = of[chain[0]]["b"], True
            state = best_end(after[chain[-1], name])
            for p in reversed(chain):
                finals[p, name] = (state, last)
                state, last = maps[p, name][state], False
                starts[p, name] = state

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, have in pieces(batches):
            at = (have[0]["pid"], name)
            costs, back = forward(before.get(at, start_costs(BEGIN)), [r["role"] for r in have])
            end, last = finals[at] if at in finals else (best_end(costs), True)
            begin, states = states_back(back, end)
            out = list(written_rows(name, have, begin, states, last))
            for lo in range(0, len(out), 4096):
                columns = zip(*out[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)

    strings = pa.list_(pa.string())
    shape = pa.schema([("conv_id", arrow), ("turn", to_arrow_type(rows.schema["turn"].dataType)), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", strings), ("appended", strings), ("cost", pa.int32()), ("rendered", pa.string())])
    return rows.mapInArrow(final, f"conv_id {kind}, turn {of_turn}, role string, new_role string, action string, inserted array<string>, appended array<string>, cost int, rendered string")
