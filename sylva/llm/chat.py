"""Chat formatting with minimum-cost role repair.

A legal conversation has an optional system turn, then user and assistant in turn, tool turns only between
assistant turns, and it ends with the assistant. A dynamic program over the automaton of the last
role picks, for the turns in order, the cheapest mix of relabelling a turn, merging it into the turn
before it and inserting empty turns; then the repaired sequence is rendered, one fragment for each turn
of the input. The fragments of a conversation, put end to end in order, are its rendered text.

Turns are sorted over range partitions, so a conversation of any length spreads over tasks. A stretch of
turns acts on the automaton as a min-plus matrix; only the first and the last stretch of a partition can
belong to a conversation that goes on elsewhere, and those two matrices a partition are solved together on the driver.

Defined results: turns sort by turn (null first) and role, those that agree in both by a fixed hash of the text, so that long texts
need not be compared over tasks; rows that agree in all of these are kept and merge like others. A null or unknown role may become any role at a small cost. A null text is empty.
Turns without a conversation id form one conversation. Role names are compared in lower case, without
white space around them. Ties go to the role listed first. An empty table gives an empty result. Control marks inside of texts are defused.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import map_arrow, pick, shared_dir

ROLES = ("system", "user", "assistant", "tool")
START = len(ROLES)
#: Costs of a relabel, of one for an unknown role, of a merge and of an empty turn.
RELABEL, UNKNOWN, MERGE, EMPTY = 3, 1, 1, 2
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system", "function": "tool"}
_NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1, 3), 3: (2, 3)}
_INF = 10**9


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest row of empty turns that makes the step from a state to a role legal."""
    out = {}
    for s in range(START + 1):
        reach: dict[int, tuple[int, ...]] = {r: () for r in _NEXT[s]}
        queue = list(_NEXT[s])
        for r in queue:
            for t in _NEXT[r]:
                if t not in reach:
                    reach[t] = (*reach[r], r)
                    queue.append(t)
        out |= {(s, r): path for r, path in reach.items()}
    return out


INSERT = _insertions()
#: Empty turns at the end, after each state.
ENDING = {s: () if s == 2 else (*INSERT[s, 2], 2) for s in range(START + 1)}


def role_code(role: str | None) -> int:
    """0 to 3 for a known role, 4 for any other."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else START


def _step(s: int, r: int) -> int:
    insert = EMPTY * len(INSERT[s, r]) if (s, r) in INSERT else _INF
    return min(insert, MERGE) if s == r else insert


def _step_matrix(code: int) -> np.ndarray:
    """Cost of going from state s to state r over a turn of the given role; no turn ends at START."""
    m = np.full((START + 1, START + 1), _INF, np.int64)
    for s in range(START + 1):
        for r in range(START):
            m[s, r] = _step(s, r) + (0 if r == code else UNKNOWN if code == START else RELABEL)
    return m


STEPS = [_step_matrix(c) for c in range(START + 1)]
END_COST = np.array([EMPTY * len(ENDING[s]) for s in range(START + 1)])


def product(codes: list[int]) -> np.ndarray:
    """Min-plus product of the steps of a stretch of turns."""
    m = None
    for c in codes:
        m = STEPS[c] if m is None else np.minimum((m[:, :, None] + STEPS[c][None, :, :]).min(axis=1), _INF)
    return m


def solve(codes: list[int], start: int = START, end: int | None = None) -> list[int]:
    """The cheapest role of each turn, from a state, to a given last role or to the end of the conversation."""
    cost = np.full(START + 1, _INF, np.int64)
    cost[start] = 0
    back = np.zeros((len(codes), START + 1), np.int8)
    for i, c in enumerate(codes):
        total = cost[:, None] + STEPS[c]
        back[i] = total.argmin(axis=0)
        cost = np.minimum(total.min(axis=0), _INF)
    state = int((cost + END_COST).argmin()) if end is None else end
    roles = []
    for i in range(len(codes) - 1, -1, -1):
        roles.append(state)
        state = int(back[i, state])
    return roles[::-1]


def open_mark(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSE_MARK = "<|im_end|>\n"


def fragment(state: int, role: int, text: str | None, last: bool) -> tuple[str, bool, int]:
    """Rendering of a turn after a state, whether it merges, and the number of empty turns around it."""
    body = (text or "").replace("<|im_", "<| im_")
    merged = state == role and MERGE <= (EMPTY * len(INSERT[state, role]) if (state, role) in INSERT else _INF)
    if merged:
        out, n = "\n\n" + body, 0
    else:
        empty = INSERT[state, role]
        n = len(empty)
        out = ("" if state == START else CLOSE_MARK) + "".join(open_mark(e) + CLOSE_MARK for e in empty) + open_mark(role) + body
    if last:
        out += CLOSE_MARK + "".join(open_mark(e) + CLOSE_MARK for e in ENDING[role])
        n += len(ENDING[role])
    return out, merged, n


def _stretches(batches):
    """Yields (conversation id, rows) for runs of one conversation; rows: (turn, role, text)."""
    current, rows, first = None, [], True
    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4])):
            if first or conv != current:
                if not first:
                    yield current, rows
                current, rows, first = conv, [], False
            rows.append((turn, role, text))
    if not first:
        yield current, rows


def _borders(sorted_rows: DataFrame, conv_type: str) -> list:
    """Of each partition the first and the last stretch: id and min-plus matrix."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        matrix = current = None
        ends, n = [], 0
        for batch in batches:
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                code = role_code(role)
                if not n or conv != current:
                    if n == 1:
                        ends.append((current, matrix))
                    current, matrix, n = conv, STEPS[code], n + 1
                else:
                    matrix = np.minimum((matrix[:, :, None] + STEPS[code][None, :, :]).min(axis=1), _INF)
        if n:
            ends.append((current, matrix))
        k = len(ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([c for c, _ in ends], pa_type), pa.array([m.ravel() for _, m in ends], pa.list_(pa.int64()))],
            ["part", "k", "conv", "m"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    pa_type = to_arrow_type(sorted_rows.schema["conv"].dataType)
    return map_arrow(sorted_rows, run, f"part int, k int, conv {conv_type}, m array<long>").collect()  # at most two rows a partition


def _plan(ends: list) -> dict[tuple[int, int], tuple[int, int | None]]:
    """(partition, 0 for its first or 1 for its last stretch) -> state before it and its last role; None: it ends the conversation."""
    ends = sorted(ends, key=lambda r: (r.part, r.k))
    size = START + 1
    out, i = {}, 0
    while i < len(ends):
        j = i + 1
        while j < len(ends) and ends[j].conv == ends[i].conv:
            j += 1
        run = ends[i:j]
        cost, back = np.full(size, _INF, np.int64), []
        cost[START] = 0
        for r in run:
            total = cost[:, None] + np.array(r.m).reshape(size, size)
            back.append(total.argmin(axis=0))
            cost = np.minimum(total.min(axis=0), _INF)
        state = int((cost + END_COST).argmin())
        for r, b in zip(reversed(run), reversed(back)):
            before = int(b[state])
            out[r.part, r.k] = (before, None if r is run[-1] else state)
            state = before
        i = j
    return out


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Of each turn: conversation, turn, role, ``new_role``, ``action`` (keep, relabel, merge or relabel+merge),
    ``n_inserted`` empty turns around it and ``rendered``, its fragment of the rendered conversation."""
    spark = turns.sparkSession
    shared_dir(spark)
    own = pick(turns, conv_id, turn, role, text).toDF("conv", "turn", "role", "text")
    keyed = own.withColumn("h", F.xxhash64("text")).withColumn("uid", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "conv", "turn", "role", "h", "uid").sortWithinPartitions("conv", "turn", "role", "h", "text", "uid").select("conv", "turn", "role", "text").checkpoint()
    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    plan = spark.sparkContext.broadcast(_plan(_borders(ordered, types["conv"])))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(ordered.schema[c].dataType) for c in ("conv", "turn")]
    names = [conv_id, turn, role, "new_role", "action", "n_inserted", "rendered"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = []
        for i, x in enumerate(_stretches(batches)):
            if len(held) == 1:
                yield from render(*held.pop(), None if i > 1 else 0)
            held.append(x)
            count = i + 1
        if held:
            yield from render(*held.pop(), 0 if count == 1 else 1)

        return

    def render(conv, rows, border):
        from pyspark import TaskContext

        start, end = (START, None) if border is None else plan.value[TaskContext.get().partitionId(), border]
        codes = [role_code(r[1]) for r in rows]
        state, out = start, []
        new = solve(codes, start, end)
        for k, ((t, r, body), c, to) in enumerate(zip(rows, codes, new)):
            text_, merged, inserted = fragment(state, to, body, end is None and k == len(rows) - 1)
            action = "+".join(["relabel"] * (to != c) + ["merge"] * merged) or "keep"
            out.append((conv, t, r, ROLES[to], action, inserted, text_))
            state = to
        for s in range(0, len(out), 1000):
            cols = list(zip(*out[s : s + 1000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kinds[0]), pa.array(cols[1], kinds[1]), *[pa.array(c, pa.string()) for c in cols[2:5]], pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.string())], names)

    return map_arrow(ordered, run, f"`{conv_id}` {types['conv']}, `{turn}` {types['turn']}, `{role}` string, new_role string, action string, n_inserted int, rendered string")
