"""Chat formatting with minimum-cost role repair.

A legal conversation is a path through an automaton: an optional system message, then user and
assistant in turns, the last one by the assistant. Each source turn may be kept, merged into the
message before, relabelled, or preceded by empty messages; every step has a cost and dynamic
programming finds the cheapest legal path. One turn is a min-plus matrix over the automaton's
states, and matrices of stretches can be multiplied, so a conversation need not be in one place.

Rows are sorted by range on (conversation, turn), so a long conversation spreads over partitions. A
conversation strictly inside a partition is repaired there. The first and last one of each
partition may go on elsewhere: their stretches (one partition's rows at most) are reduced to
matrices, the matrices of a conversation (one for each partition) give every stretch its state at
entry and exit, and then the stretches are repaired on their own.

Defined results: a null role, or one that is not known, is relabelled at the usual cost; a null text
is empty; a null conversation id is a conversation of its own; turns with the same number, and null
ones first, go by role, then text; repeated rows are turns; an empty table gives an empty table;
other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

MERGE, RELABEL, INSERT = 2, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40

Step = tuple[int, str, tuple[int, ...]]  # cost, action, inserted roles


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def _inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest ways of empty messages from one state to another."""
    ways = {(s, s): () for s in LEGAL}
    for _ in range(3):
        for (a, b), way in list(ways.items()):
            for c in LEGAL[b]:
                if (a, c) not in ways or len(ways[a, c]) > len(way) + 1:
                    ways[a, c] = (*way, c)
    return ways


def steps() -> dict[int, dict[tuple[int, int], Step]]:
    """For each role of a turn (0: unknown) the cheapest step from state to state.

    Of equally cheap steps: keep before merge before relabel before what needs insertions.
    """
    out: dict[int, dict[tuple[int, int], Step]] = {}
    for role in range(4):
        table: dict[tuple[int, int], Step] = {}

        def offer(a: int, b: int, step: Step, table=table) -> None:
            if (a, b) not in table or step[0] < table[a, b][0]:
                table[a, b] = step

        for (a, mid), way in sorted(_inserted().items(), key=lambda x: (len(x[1]), x[0])):
            extra = INSERT * len(way)
            for b in LEGAL[mid]:
                if b == role:
                    offer(a, b, (extra, "keep", way))
            if mid != START and not way:
                offer(a, mid, (MERGE if mid == role else MERGE + RELABEL, "merge", way))
            for b in LEGAL[mid]:
                if b != role:
                    offer(a, b, (extra + RELABEL, "relabel", way))
        out[role] = table
    return out


STEPS = steps()
MATRICES = np.full((4, 4, 4), FAR, np.int64)
for _r, _table in STEPS.items():
    for (_a, _b), _s in _table.items():
        MATRICES[_r, _a, _b] = _s[0]
#: What it costs to end in a state, and the messages that are then added.
FINISH = {s: (INSERT * len(w), w) for (s, t), w in _inserted().items() if t == ASSISTANT}
END = np.array([FINISH[s][0] if s != START else FAR for s in range(4)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        out = product(out, MATRICES[r])
    return out


def best_path(roles: list[int], entry: int = START, leave: int | None = None) -> list[int]:
    """States after each turn on the cheapest path; it ends in `leave`, or where ending is cheapest."""
    cost = np.where(np.arange(4) == entry, 0, FAR)
    back = []
    for r in roles:
        ways = cost[:, None] + MATRICES[r]
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), FAR)
    state = int((cost + END).argmin()) if leave is None else leave
    path = [state]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1][1:]


def escape(text: str) -> str:
    return text.replace("<|", "<\\|")


def render(roles: list[int], contents: list[str], entry: int, path: list[int], last: bool) -> list[tuple[str, str, int, str]]:
    """(role, action, cost, fragment) for each turn: the fragments in order are the conversation."""
    out, state = [], entry
    for k, (r, text, to) in enumerate(zip(roles, contents, path)):
        cost, action, way = STEPS[r][state, to]
        if action == "merge":
            fragment = "\n" + escape(text)
        else:
            close = "" if state == START else "<|end|>\n"
            empty = "".join(f"<|{ROLES[x]}|>\n<|end|>\n" for x in way)
            fragment = f"{close}{empty}<|{ROLES[to]}|>\n{escape(text)}"
        if last and k == len(path) - 1:
            more, way = FINISH[to]
            cost += more
            fragment += "<|end|>\n" + "".join(f"<|{ROLES[x]}|>\n<|end|>\n" for x in way)
            action += "+finish" if way else ""
        out.append((ROLES[to], ("insert+" if STEPS[r][state, to][2] else "") + action, int(cost), fragment))
        state = to
    return out


OUT = "conv_id long, turn long, source_role string, role string, action string, cost long, fragment string"
_COLUMNS = ["conv_id", "turn", "source_role", "role", "action", "cost", "fragment"]


def _repaired(conv, turns: list, roles: list, contents: list, entry: int = START, leave: int | None = None, last: bool = True) -> list[tuple]:
    numbers = [role_number(r) for r in roles]
    made = render(numbers, contents, entry, best_path(numbers, entry, leave), last)
    return [(conv, t, r, *x) for t, r, x in zip(turns, roles, made)]


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each source turn: its role and action after repair, the cost, and the rendered fragment."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("source_role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Equal rows may lie in any order, but not all in one partition.
    order = ["conv_id", "turn", "source_role", F.xxhash64("text"), "text"]
    ranged = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order[:4], "any")
    ranged = ranged.sortWithinPartitions(*order, "any").drop("any").withColumn("part", F.spark_partition_id())

    def inside(batches):
        """Repairs what lies strictly inside the partition; the first and last conversation stay open."""
        out: list[tuple] = []
        group: list[tuple] = []
        number = at = 0

        def closed(rows):
            return [(*x, None, None) for x in _repaired(rows[0][0], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])]

        def opened(rows, at):
            return [(c, t, r, None, None, None, x, p, at + k) for k, (c, t, r, x, p) in enumerate(rows)]

        streaming = True  # rows of the first conversation go on as they come
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "source_role", "text", "part"))):
                if group and r[0] != group[0][0]:
                    out.extend(opened(group, at) if number == 0 else closed(group))
                    at += len(group) if number == 0 else 0
                    group, number, streaming = [], number + 1, False
                group.append(r)
                if streaming and len(group) == 1000:
                    out.extend(opened(group[:-1], at))
                    at += len(group) - 1
                    group = group[-1:]
                if len(out) >= 1000:
                    yield _open_batch(out)
                    out = []
        out.extend(opened(group, at))
        yield _open_batch(out)

    mixed = cut_lineage(ranged.mapInArrow(inside, f"{OUT}, part int, place long"))
    done = mixed.filter("part is null").select(*_COLUMNS)
    open_rows = mixed.filter("part is not null").select("conv_id", "turn", "source_role", F.col("fragment").alias("text"), "part", "place")

    def to_matrix(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        m = matrix([role_number(r) for r in frame.sort_values("place")["source_role"]])
        return pd.DataFrame({"conv_id": pd.array([key[0]], "Int64"), "part": [key[1]], "m": [m.ravel().tolist()]})

    def to_states(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        ms = [np.array(m).reshape(4, 4) for m in frame["m"]]
        cost, back = np.where(np.arange(4) == START, 0, FAR), []
        for m in ms:
            ways = cost[:, None] + m
            back.append(ways.argmin(axis=0))
            cost = np.minimum(ways.min(axis=0), FAR)
        states = [int((cost + END).argmin())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states = states[::-1]
        return pd.DataFrame(
            {"conv_id": pd.array([key[0]] * len(ms), "Int64"), "part": frame["part"].to_numpy(), "entry": states[:-1], "leave": states[1:], "last": [k == len(ms) - 1 for k in range(len(ms))]}
        )

    def to_rows(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("place")
        turns = [None if pd.isna(t) else int(t) for t in f["turn"]]
        one = f.iloc[0]
        roles = [None if pd.isna(r) else r for r in f["source_role"]]
        made = _repaired(None if pd.isna(key[0]) else int(key[0]), turns, roles, f["text"].tolist(), int(one["entry"]), int(one["leave"]), bool(one["last"]))
        return pd.DataFrame(made, columns=_COLUMNS).astype({"conv_id": "Int64", "turn": "Int64"})

    stretch = open_rows.select("conv_id", "part", "place", "source_role").groupBy("conv_id", "part").applyInPandas(to_matrix, "conv_id long, part int, m array<long>")
    states = cut_lineage(stretch.groupBy("conv_id").applyInPandas(to_states, "conv_id long, part int, entry int, leave int, last boolean"))
    same = states.withColumnsRenamed({"conv_id": "c", "part": "p"})
    joined = open_rows.join(same, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    return done.unionByName(joined.groupBy("conv_id", "part").applyInPandas(to_rows, OUT))


def _open_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*_COLUMNS, "part", "place"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
