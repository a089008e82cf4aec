"""Chat formatting: the cheapest repair of a conversation's roles, then its rendered text.

A legal conversation is an optional system turn, then user and assistant turns by turns. Dynamic
programming over that automaton chooses, for every turn, to keep it, to merge it into the turn before,
to give it another role, or to put empty turns before it, so that the sum of costs is least.

A conversation is cut into parts of neighbouring turn numbers, so that a very long one is not one task's
work. A part's costs from each state to each state are a small matrix; the matrices of a conversation,
one for a thousand turns, say in which states the parts of the cheapest repair begin and end; each part
then finds its own way between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, STATES = 0, 4
#: Costs of a merge, of another role and of an empty turn.
MERGE, RELABEL, INSERT = 1, 2, 3
#: Which role may follow which state.
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Turn numbers in a part.
PART = 1024
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
#: What a text has in place of the marks' beginning, so that no text can end its turn or begin another's.
ESCAPE = ("<|", "<\\|")
_FAR = 1 << 40


def _steps() -> dict[tuple[int, int], dict[int, tuple[int, tuple[int, ...], bool]]]:
    """(state, role) -> {next state: (cost, empty turns put before, merged)}; role 0 is any unknown one.

    Of equal costs a kept or relabelled turn goes before a merge, and that before empty turns.
    """
    ways: dict[int, list[tuple[int, ...]]] = {}
    for s in range(STATES):
        ways[s] = [(), *((a,) for a in FOLLOWS[s]), *((a, b) for a in FOLLOWS[s] for b in FOLLOWS[a])]
    out = {}
    for s in range(STATES):
        for role in range(STATES):
            best: dict[int, tuple[int, int, tuple[int, ...], bool]] = {}
            for put in ways[s]:
                last = put[-1] if put else s
                options = [(q, INSERT * len(put), 0, False) for q in FOLLOWS[last]]
                if not put and s != START:
                    options.append((s, MERGE, 1, True))
                for q, cost, rank, merged in options:
                    full = (cost + RELABEL * (q != role), rank + 2 * len(put), put, merged)
                    best[q] = min(best.get(q, full), full)
            out[s, role] = {q: (c, put, merged) for q, (c, _, put, merged) in best.items()}
    return out


STEPS = _steps()
#: What it costs to stop in a state: a system turn alone is given an empty user turn.
STOP = {0: (0, ()), 1: (INSERT, (2,)), 2: (0, ()), 3: (0, ())}


def role_number(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def matrix(roles: list[int]) -> np.ndarray:
    """Least costs from each state before the turns to each state after them."""
    m = np.full((STATES, STATES), _FAR, dtype=np.int64)
    np.fill_diagonal(m, 0)
    single = {r: _matrix_of(r) for r in set(roles)}
    for r in roles:
        m = np.minimum((m[:, :, None] + single[r][None, :, :]).min(axis=1), _FAR)
    return m


def _matrix_of(role: int) -> np.ndarray:
    m = np.full((STATES, STATES), _FAR, dtype=np.int64)
    for s in range(STATES):
        for q, (cost, _, _) in STEPS[s, role].items():
            m[s, q] = cost
    return m


def crossings(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, state after) of each part of the cheapest repair; of equal ones the lower states."""
    costs = [np.array([0] + [_FAR] * (STATES - 1), dtype=np.int64)]
    for m in parts:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _FAR))
    after = int(np.argmin(costs[-1] + np.array([STOP[s][0] for s in range(STATES)])))
    out = []
    for m, cost in zip(reversed(parts), reversed(costs[:-1]), strict=True):
        before = int(np.argmin(cost + m[:, after]))
        out.append((before, after))
        after = before
    return out[::-1]


def repair(roles: list[int], before: int, after: int) -> tuple[int, list[tuple[int, tuple[int, ...], bool]]]:
    """(cost, [(role given, empty turns put before, merged)]) of the cheapest way between two states."""
    costs, came = {before: 0}, []
    for r in roles:
        step: dict[int, tuple[int, int]] = {}
        for s in sorted(costs):
            for q, (c, _, _) in STEPS[s, r].items():
                if q not in step or costs[s] + c < step[q][0]:
                    step[q] = (costs[s] + c, s)
        came.append({q: s for q, (_, s) in step.items()})
        costs = {q: c for q, (c, _) in step.items()}
    path, q = [], after
    for r, back in zip(reversed(roles), reversed(came), strict=True):
        s = back[q]
        _, put, merged = STEPS[s, r][q]
        path.append((q, put, merged))
        q = s
    return costs[after], path[::-1]


def render(texts: list[str], way: list[tuple[int, tuple[int, ...], bool]], opened: bool, last: int | None) -> tuple[str, int]:
    """(text, turns begun). A turn is closed when the next one begins, or at the end if ``last`` is its state."""
    out, turns = [], 0

    def begin(role: int) -> None:
        nonlocal opened, turns
        if opened:
            out.append(CLOSE)
        out.append(OPEN.format(ROLES[role - 1]))
        opened, turns = True, turns + 1

    for text, (role, put, merged) in zip(texts, way, strict=True):
        for r in put:
            begin(r)
        if merged:
            out.append("\n")
        else:
            begin(role)
        out.append(text.replace(*ESCAPE))
    if last is not None:
        for r in STOP[last][1]:
            begin(r)
        out.append(CLOSE)
    return "".join(out), turns


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their first two columns, group by group; never more than a group is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        low = 0
        for k in range(1, len(a) + 1):
            if k < len(a) and a[k] == a[k - 1] and b[k] == b[k - 1]:
                continue
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (a[low], b[low]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, k - low))
            low = k
    if held:
        yield pa.Table.from_batches(held)


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    r"""(key, part, n_parts, total_cost, n_turns, cost, rendered): a row for each part of a repaired conversation.

    The texts of a conversation's parts, joined in the order of ``part``, make the whole, and their costs add up to
    ``total_cost``. No row holds a conversation of any length: a part is the turns whose numbers have the same
    multiple of ``PART`` below them, so that a usual conversation is one row. Turns go by number, nulls first, then by role and by a hash of the
    text. Marks inside a text are escaped (``<|`` as ``<\|``). An unknown or null role must be replaced, a null text is empty, repeated rows are turns of
    their own, and a null key is a conversation of its own. An empty table gives an empty one.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    turns = df.select(
        name.alias("c"),
        F.coalesce(F.floor(F.col(turn) / PART), F.lit(-(1 << 40))).cast("long").alias("part"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("t"),
        F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role)), F.lit(0)).cast("int").alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
        F.col(key).alias("k"),
    ).withColumn("h", F.xxhash64("x"))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, list[int]]] = []
        for g in _groups(batches):
            out.append((g.column(0)[0].as_py(), g.column(1)[0].as_py(), matrix(g.column("r").to_pylist()).ravel().tolist()))
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        c, part, m = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(part, pa.int64()), pa.array(m, pa.list_(pa.int64()))], ["c", "part", "m"])

    small = turns.select("c", "part", "t", "r", "h").repartition("c", "part").sortWithinPartitions("c", "part", "t", "r", "h")
    matrices = small.mapInArrow(costs, "c string, part long, m array<long>")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, part, before, after, last, parts, total = [], [], [], [], [], [], []
            for name, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cross = crossings([np.array(x["m"], dtype=np.int64).reshape(STATES, STATES) for x in ms])
                whole = sum(x["m"][a * STATES + b] for x, (a, b) in zip(ms, cross, strict=True)) + STOP[cross[-1][1]][0]
                parts += [len(ms)] * len(ms)
                total += [whole] * len(ms)
                for k, (x, (a, b)) in enumerate(zip(ms, cross, strict=True)):
                    c.append(name)
                    part.append(x["part"])
                    before.append(a)
                    after.append(b)
                    last.append(k == len(ms) - 1)
            cols = [pa.array(c, pa.string()), pa.array(part, pa.int64()), pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(last, pa.bool_())]
            cols += [pa.array(parts, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["c", "part", "before", "after", "last", "parts", "total"])

    gathered = matrices.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("ms"))
    crossed = gathered.mapInArrow(ends, "c string, part long, before int, after int, last boolean, parts long, total long")
    kind = df.schema[key].dataType.simpleString()

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            before, after, last = (g.column(x)[0].as_py() for x in ("before", "after", "last"))
            cost, way = repair(g.column("r").to_pylist(), before, after)
            body, n = render(g.column("x").to_pylist(), way, before != START, after if last else None)
            cost += STOP[after][0] if last else 0
            values = [pa.array([n], pa.int64()), pa.array([cost], pa.int64()), pa.array([body])]
            first = [g.column(x).combine_chunks()[:1] for x in ("k", "part", "parts", "total")]
            yield pa.RecordBatch.from_arrays([*first, *values], [key, "part", "n_parts", "total_cost", "n_turns", "cost", "rendered"])

    # dealt before the join, so that a part lies in one partition however the join is run
    whole = turns.repartition("c", "part").join(crossed, ["c", "part"]).sortWithinPartitions("c", "part", "t", "r", "h")
    return whole.select("c", "part", "k", "r", "x", "before", "after", "last", "parts", "total").mapInArrow(
        rendered, f"`{key}` {kind}, part long, n_parts long, total_cost long, n_turns long, cost long, rendered string"
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, repaired and rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op8_chat": op8_chat}
