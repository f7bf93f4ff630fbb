"""Chat formatting: minimum-cost repair of turn roles over an automaton of legal turns, then rendering.

Legal conversations are an optional system turn, then user and assistant turns in alternation, ending with the
assistant. A turn may be kept, merged into the turn before it (same role), relabelled, or preceded by inserted empty
turns; dynamic programming over the automaton's states picks the cheapest sequence of these.

Conversations are dealt in blocks of BLOCK turn numbers. Each block gives the cost from every entry state to every exit
state (a min-plus matrix); a conversation's few matrices give each block its entry and exit state; blocks then
choose their repairs on their own. So a conversation of any length is never in one task as a whole.

Defined cases: turns are ordered by turn (nulls first), then role, then text, so repeated and tied rows have a fixed order;
a null text is empty; a null or unknown role is relabelled; a row with a null conversation id is a conversation of its
own (equal such rows are one); an empty table gives an empty table; other columns are ignored. Of repairs with equal cost the first in the order
keep, merge, relabel, insert is taken, at the latest turn that allows a choice.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table

BLOCK = 512
MERGE, RELABEL, INSERT = 1, 2, 3
ROLES = ("system", "user", "assistant")
#: States: no turn yet, or the role of the last turn. Legal next roles of each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
JOIN, END = "\n", "<|end|>\n"
NEVER = 1 << 40


def insertions(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which role may follow state."""
    for n in range(3):
        for path in itertools.product((SYSTEM, USER, ASSISTANT), repeat=n):
            steps = (state, *path, role)
            if all(b in NEXT[a] for a, b in itertools.pairwise(steps)):
                return path
    return None


#: (state, turn's role or 0) -> choices (cost, rank, action, inserted roles, new state)
CHOICES: dict[tuple[int, int], list[tuple[int, int, str, tuple[int, ...], int]]] = {}
for _state in range(4):
    for _role in range(4):
        _found = []
        if _role == _state != START:
            _found.append((MERGE, 1, "merge", (), _state))
        for _to in (SYSTEM, USER, ASSISTANT):
            _path = insertions(_state, _to)
            if _path is not None:
                _cost = INSERT * len(_path) + RELABEL * (_to != _role)
                _found.append((_cost, 0 if not _cost else 2 + bool(_path), "keep" if _to == _role else "relabel", _path, _to))
        CHOICES[_state, _role] = sorted(_found)
#: Empty turns that end a conversation legally, by its last state.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def forward(roles: list[int], cost: list[int]) -> list[list[tuple[int, int, int] | None]]:
    """For each turn and state after it: (cost, state before, choice), from the costs of the states before the first turn."""
    table_: list[list[tuple[int, int, int] | None]] = []
    for role in roles:
        best: list[tuple[int, int, int, int] | None] = [None] * 4
        for state in range(4):
            if cost[state] >= NEVER:
                continue
            for k, (c, rank, _, _, to) in enumerate(CHOICES[state, role]):
                new = (cost[state] + c, rank, state, k)
                if best[to] is None or new < best[to]:
                    best[to] = new
        cost = [b[0] if b else NEVER for b in best]
        table_.append([(b[0], b[2], b[3]) if b else None for b in best])
    return table_


def block_costs(roles: list[int]) -> list[int]:
    """The 16 costs from each entry state to each exit state."""
    out = []
    for entry in range(4):
        last = forward(roles, [0 if s == entry else NEVER for s in range(4)])[-1]
        out += [cell[0] if cell else NEVER for cell in last]
    return out


def block_states(costs: list[list[int]]) -> tuple[list[tuple[int, int]], int]:
    """Entry and exit state of each of a conversation's blocks, and the whole cost, closing turns included."""
    best, back = [0] + [NEVER] * 3, []
    for c in costs:
        options = [min((best[s] + c[4 * s + t], s) for s in range(4)) for t in range(4)]
        back.append([s for _, s in options])
        best = [x for x, _ in options]
    total, state = min((best[s] + INSERT * len(CLOSE[s]), s) for s in range(4))
    path = []
    for b in reversed(back):
        path.append((b[state], state))
        state = b[state]
    return path[::-1], total


def repair_block(roles: list[int], texts: list[str], entry: int, exit_: int, closes: bool) -> list[tuple[str, str, str]]:
    """(role, action, rendered) pieces of a block; a conversation's rendering is its blocks' pieces end to end."""
    cells, state, chosen = forward(roles, [0 if s == entry else NEVER for s in range(4)]), exit_, []
    for row in reversed(cells):
        _, before, k = row[state]
        chosen.append((before, k))
        state = before
    out = []
    state = entry
    name = lambda s: ROLES[s - 1]
    opened = lambda s, t, after: (END if after != START else "") + f"<|{name(s)}|>\n{t}"
    for role, text, (before, k) in zip(roles, texts, reversed(chosen), strict=True):
        _, _, action, path, to = CHOICES[before, role][k]
        if action == "merge":
            out.append((name(to), action, JOIN + text))
        else:
            for extra in path:
                out.append((name(extra), "insert", opened(extra, "", state)))
                state = extra
            out.append((name(to), action, opened(to, text, state)))
        state = to
    if closes:
        for extra in CLOSE[state]:
            out.append((name(extra), "insert", opened(extra, "", state)))
            state = extra
        if out:
            role, action, piece = out[-1]
            out[-1] = (role, action, piece + END)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each as one table; a run may span batches."""
    held: list[pa.RecordBatch] = []
    key_of = lambda b, i: tuple(b.column(k)[i].as_py() for k in keys)
    for batch in batches:
        n, i = batch.num_rows, 0
        if not n:
            continue
        columns = [np.asarray(batch.column(k).dictionary_encode().indices) if batch.column(k).type == pa.string() else np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and key_of(held[-1], 0) != key_of(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for j in [*change.tolist(), n]:
            held.append(batch.slice(i, j - i))
            if j < n:
                yield pa.Table.from_batches(held)
                held = []
            i = j
    if held:
        yield pa.Table.from_batches(held)


def format_chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, block, index, role, action, rendered, cost) for each repaired turn and each merged piece, cost being the conversation's."""
    own = F.concat(F.lit("null:"), F.xxhash64(F.col(turn), F.col(role), F.col(text)).cast("string"))
    conv = F.when(F.col(conversation).isNull(), own).otherwise(F.concat(F.lit("id:"), F.col(conversation).cast("string")))
    kind = rows.schema[conversation].dataType.simpleString()
    slim = rows.select(conv.alias("conv"), F.coalesce(F.floor(F.col(turn) / BLOCK), F.lit(-1)).cast("long").alias("block"), F.col(turn).cast("double").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("conv", "block")):
            yield pa.RecordBatch.from_arrays([pa.array([group.column("conv")[0].as_py()]), pa.array([group.column("block")[0].as_py()], pa.int64()), pa.array([block_costs([role_code(r) for r in group.column("role").to_pylist()])], pa.list_(pa.int64()))], ["conv", "block", "costs"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.sort(key=lambda b: b["block"])
                path, total = block_states([b["costs"] for b in blocks])
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([conv_] * n), pa.array([b["block"] for b in blocks], pa.int64()), pa.array([p[0] for p in path], pa.int64()), pa.array([p[1] for p in path], pa.int64()), pa.array([i == n - 1 for i in range(n)]), pa.array([total] * n, pa.int64())], ["conv", "block", "entry", "exit", "closes", "cost"])

    out_type = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("index", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string()), ("cost", pa.int64())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("conv", "block")):
            first = {c: group.column(c)[0].as_py() for c in ("conv", "block", "entry", "exit", "closes", "cost")}
            pieces = repair_block([role_code(r) for r in group.column("role").to_pylist()], group.column("text").to_pylist(), first["entry"], first["exit"], first["closes"])
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([first["conv"]] * n, [first["block"]] * n, list(range(n)), *map(list, zip(*pieces, strict=True)), [first["cost"]] * n), out_type, strict=True)], schema=out_type)

    order = ["conv", "block", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text"]
    dealt = slim.repartition("conv", "block").sortWithinPartitions(*order)
    costs = dealt.select("conv", "block", "role").mapInArrow(cost, "conv string, block long, costs array<long>")
    decided = costs.groupBy("conv").agg(F.collect_list(F.struct("block", "costs")).alias("blocks")).mapInArrow(states, "conv string, block long, entry long, exit long, closes boolean, cost long")
    joined = slim.join(decided, ["conv", "block"]).repartition("conv", "block").sortWithinPartitions(*order)
    found = joined.mapInArrow(repair, "conv string, block long, index long, role string, action string, rendered string, cost long")
    back = F.when(F.col("conv").startswith("id:"), F.substring("conv", 4, 1 << 30)).cast(kind)
    return found.select(back.alias(conversation), "block", "index", "role", "action", "rendered", "cost")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
