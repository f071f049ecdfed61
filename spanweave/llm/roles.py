"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant turns in turns,
closed by the assistant.  A turn may keep its role, take another, or be merged into the turn
before it; empty turns may be inserted.  Dynamic programming over the automaton of legal turns
finds the cheapest repair, which is then rendered.

Turns are dealt by ranges of (conversation, order) and a conversation is cut into blocks of turns
in order.  Each block is reduced to a small matrix of least costs between automaton states; those of
one partition are reduced again, the few that are left are chained for each conversation, and each
block is then repaired on its own between its two states.  So neither a huge conversation nor
very many turns under one number are a huge task.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged, table

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Other names of roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: The role a turn may have after each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: a turn takes another role; a turn without a known role takes one; a turn is merged
#: into one of its own role; an empty turn is inserted.
RELABEL, NAME, MERGE, INSERT = 4, 2, 3, 5
#: Turns of a block, and letters of a text that may part ranges of turns.
BLOCK, LETTERS = 512, 32
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
INF = float("inf")


def role_kind(role: str | None) -> int:
    """The automaton state of a role name; 0 if it is null or unknown."""
    return ALIASES.get((role or "").strip().lower(), 0)


def _inserted(state: int, role: int) -> tuple[int, ...] | None:
    """The shortest empty turns between a state and a turn with `role`; None if there are none."""
    ways = [((), state)]
    for _ in range(3):
        for path, at in ways:
            if role in LEGAL[at]:
                return path
        ways = [((*path, x), x) for path, at in ways for x in LEGAL[at] if x != SYSTEM]
    return None


def _steps() -> list[list[list[tuple[float, str, tuple[int, ...]]]]]:
    """By kind of turn, state before and state after: (cost, action, inserted turns)."""
    table = [[[(INF, "", ())] * 4 for _ in range(4)] for _ in range(4)]
    for kind, state, after in product(range(4), range(4), range(1, 4)):
        change = 0 if kind == after else RELABEL if kind else NAME
        ways = []
        if (gap := _inserted(state, after)) is not None:
            ways.append((change + INSERT * len(gap), "relabel" if change else "keep", gap))
        if state == after:
            ways.append((MERGE + change, "merge_relabel" if change else "merge", ()))
        if ways:
            table[kind][state][after] = min(ways, key=lambda w: w[0])  # on a tie a turn of its own
    return table


STEP = _steps()
COST = np.array([[[c for c, _, _ in row] for row in rows] for rows in STEP])
#: The empty turns that close a conversation, by its last state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END = np.array([INSERT * len(CLOSING[s]) for s in range(4)], float)


def matrix(kinds: list[int]) -> np.ndarray:
    """Least costs between the states before and after a run of turns."""
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for k in kinds:
        m = (m[:, :, None] + COST[k][None]).min(axis=1)
    return m


def path(kinds: list[int], first: int, last: int) -> list[int]:
    """States after each turn of a cheapest way from `first` to `last`; ties go to the state
    that comes first in the automaton."""
    cost = np.full(4, INF)
    cost[first] = 0
    back = []
    for k in kinds:
        ways = cost[:, None] + COST[k]
        back.append(ways.argmin(axis=0))
        cost = ways.min(axis=0)
    states = [last]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1] if kinds else []


def joined(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of several runs of turns, one after the other."""
    m = matrices[0]
    for other in matrices[1:]:
        m = (m[:, :, None] + other[None]).min(axis=1)
    return m


def chain(matrices: list[np.ndarray], first: int = START, last: int | None = None) -> list[tuple[int, int]]:
    """The states before and after each run on a cheapest way from `first` to `last`, or to where
    closing the conversation costs least."""
    costs = [np.where(np.arange(4) == first, 0.0, INF)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    state = int((costs[-1] + END).argmin()) if last is None else last
    out = []
    for cost, m in zip(costs[-2::-1], reversed(matrices)):
        before = int((cost + m[:, state]).argmin())
        out.append((before, state))
        state = before
    return out[::-1]


def _safe(text: str | None) -> str:
    return (text or "").replace("<|", "<\\|")


def _empty(roles) -> str:
    return "".join(OPEN.format(NAMES[r]) + CLOSE for r in roles)


def repaired(roles: list[str | None], texts: list[str | None], first: int, last: int, closing: bool):
    """(role, action, inserted, cost, rendered) of each turn of a block.

    A turn's rendering closes the turn before it unless it is merged into that; the last turn
    of the conversation closes itself.  So renderings in order are the conversation.
    """
    kinds = [role_kind(r) for r in roles]
    states, before = path(kinds, first, last), first
    for i, (k, text, after) in enumerate(zip(kinds, texts, states)):
        cost, action, gap = STEP[k][before][after]
        if action.startswith("merge"):
            piece = "\n" + _safe(text)
        else:
            piece = ("" if before == START else CLOSE) + _empty(gap) + OPEN.format(NAMES[after]) + _safe(text)
        names = [NAMES[g] for g in gap]
        if closing and i == len(kinds) - 1:
            piece += CLOSE + _empty(CLOSING[after])
            names += [NAMES[g] for g in CLOSING[after]]
            cost += END[after]
        yield NAMES[after], action, ",".join(names), int(cost), piece
        before = after


def _groups(parts, keys: int):
    """Blocks of rows with equal first columns, from sorted batches; one block at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in parts:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(keys))))
        low = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > low:
                    held.append(b.slice(low, i - low))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, low, last = [], i, key
        if b.num_rows > low:
            held.append(b.slice(low))
    if held:
        yield last, pa.Table.from_batches(held)


def _batched(rows, schema: pa.Schema, size: int = 4096):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ROWS = pa.schema([("conv_id", pa.int64()), ("blk", pa.int64()), ("head", pa.int64()), ("i", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("m", pa.list_(pa.float64()))])
_CUT = "conv_id long, blk long, head long, i long, turn long, role string, text string, n long, m array<double>"
_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ord", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])
RESULT = "conv_id long, turn long, ord long, role string, action string, inserted string, cost long, rendered string"


def _cut(block: int):
    """Sorted turns with their block, its first one of the conversation in the partition (head), and
    their place in it; and for each block a row with its matrix."""

    def run(parts):
        number = TaskContext.get().partitionId() << 32

        def rows():
            nonlocal number
            head, before, kinds = None, object(), []
            for b in parts:
                for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                    if head is not None and (conv != before or len(kinds) == block):
                        yield before, number, head, None, None, None, None, len(kinds), matrix(kinds).ravel().tolist()
                        number, kinds = number + 1, []
                    if head is None or conv != before:
                        head, before = number, conv
                    yield conv, number, head, len(kinds), turn, role, text, None, None
                    kinds.append(role_kind(role))
            if kinds:
                yield before, number, head, None, None, None, None, len(kinds), matrix(kinds).ravel().tolist()

        yield from _batched(rows(), _ROWS)

    return run


def _grids(t: pa.Table) -> list[np.ndarray]:
    return [np.array(m).reshape(4, 4) for m in t.column("m").to_pylist()]


_HEADS = pa.schema([("conv_id", pa.int64()), ("head", pa.int64()), ("n", pa.int64()), ("m", pa.list_(pa.float64()))])
_ENDS = pa.schema([("at", pa.int64()), ("base", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("closing", pa.bool_())])


def _reduced(parts):
    """Blocks (head, blk, conv_id, n, m), sorted, as one matrix for each head."""

    def rows():
        for (head,), t in _groups(parts, 1):
            yield t.column("conv_id")[0].as_py(), head, sum(t.column("n").to_pylist()), joined(_grids(t)).ravel().tolist()

    yield from _batched(rows(), _HEADS)


def _ends(t: pa.Table, by: str, base: int, first: int, last: int | None, closing: bool):
    ends = chain(_grids(t), first, last)
    for i, (at, n, (a, z)) in enumerate(zip(t.column(by).to_pylist(), t.column("n").to_pylist(), ends)):
        yield at, base, a, z, closing and i == len(ends) - 1
        base += n


def _tops(parts):
    """The ends of each head, from rows (conv_id, head, n, m), sorted."""
    yield from _batched((r for _, t in _groups(parts, 1) for r in _ends(t, "head", 0, START, None, True)), _ENDS)


def _within(parts):
    """The ends of each block, from rows (head, blk, n, m) with the ends of their head, sorted."""

    def rows():
        for _, t in _groups(parts, 1):
            base, first, last, closing = (t.column(f"h_{c}")[0].as_py() for c in ("base", "first", "last", "closing"))
            yield from _ends(t, "blk", base, first, last, closing)

    yield from _batched(rows(), _ENDS)


def _repairs(parts):
    def rows():
        for _, t in _groups(parts, 1):
            ends = t.slice(0, 1).to_pylist()[0]  # the row with the block's ends sorts first
            turns = t.slice(1)
            conv, texts, roles, number = (turns.column(c).to_pylist() for c in ("conv_id", "text", "role", "turn"))
            for i, out in enumerate(repaired(roles, texts, ends["first"], ends["last"], ends["closing"])):
                yield conv[i], number[i], ends["base"] + i, *out

    yield from _batched(rows(), _OUT)


def repair_roles(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each turn (conv_id, turn, role, text): what became of it and its rendering.

    ord counts a conversation's turns in order of (turn, role, text), nulls first, so turns
    with the same number are in a defined order; a null conv_id is a conversation like any
    other; null texts render as empty ones; long texts are rendered whole; repeated rows are
    turns each; no turns give no rows.  Renderings by ord join to the repaired conversation,
    and costs add up to its cost.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartitionByRange(partitions(spark), "conv_id", "turn", "role", F.substring("text", 1, LETTERS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = staged(dealt.mapInArrow(_cut(block), _CUT), "turns")
    ms = cut.where("i IS NULL").select("head", "blk", "conv_id", "n", "m")
    kinds = "at long, base long, first int, last int, closing boolean"
    heads = ms.repartition("head").sortWithinPartitions("head", "blk").mapInArrow(_reduced, "conv_id long, head long, n long, m array<double>")
    tops = heads.repartition("conv_id").sortWithinPartitions("conv_id", "head").mapInArrow(_tops, kinds)
    known = ms.join(tops.select(F.col("at").alias("head"), *[F.col(c).alias(f"h_{c}") for c in ("base", "first", "last", "closing")]), "head")
    ends = known.repartition("head").sortWithinPartitions("head", "blk").mapInArrow(_within, kinds).withColumnRenamed("at", "blk")
    nothing = lambda kind: F.lit(None).cast(kind)
    both = cut.where("i IS NOT NULL").select("blk", "i", "conv_id", "turn", "role", "text", nothing("long").alias("base"), nothing("int").alias("first"), nothing("int").alias("last"), nothing("boolean").alias("closing")).unionAll(
        ends.select("blk", F.lit(-1).cast("long"), nothing("long"), nothing("long"), nothing("string"), nothing("string"), "base", "first", "last", "closing")
    )
    return both.repartition("blk").sortWithinPartitions("blk", "i").mapInArrow(_repairs, RESULT)


def op2_role_repair(spark, sf_dir: str) -> DataFrame:
    """Each turn of conversations, repaired and rendered; rules as in repair_roles()."""
    return repair_roles(table(spark, sf_dir, "conversations"))
