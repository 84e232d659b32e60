"""Chat formatting with role repair of least cost.

Legal conversations are the paths of an automaton: an optional system turn,
then user and assistant in alternation, starting with user. Each given turn is
appended, merged into the open turn, or appended after an empty turn that is
inserted before it, under its own role or another; the cheapest sequence of
such steps is found by dynamic programming over the automaton's states. Of
equal costs the path counts that is smallest from its end, state by state.

The result is in chunks of bounded size, at any length of a conversation: a
chunk ends where the turns before or the characters before pass a multiple of
the limit. Most conversations are one chunk, which one task solves when it has
read it. Longer ones are dealt out by chunk, however many rows one of them
holds: the costs of crossing a chunk from each state to each state compose by
the (min, +) product to the costs ahead of every chunk; with these each chunk
tells for every state it may end in where its path began, and the states
between chunks follow from the end. What streams through one task there is one
small row for each chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialise
from .common import table

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Other names for the three roles.
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs; the relabelling of a role that is not known is cheap.
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 1, 2, 3, 1
NEVER = 1 << 40
#: A chunk of the result ends at so many turns or characters.
CHUNK_TURNS, CHUNK_CHARS = 1024, 1 << 20
MARK = re.compile(r"<(\\*)\|")


def steps(role: int, state: int) -> list[tuple[int, int, str]]:
    """(cost, new state, step) for a turn of ``role`` (0: not known) in ``state``, in order of preference."""
    out = []
    for target in (role, USER, ASSISTANT, SYSTEM) if role else (USER, ASSISTANT, SYSTEM):
        extra = 0 if target == role else RELABEL if role else NAME_UNKNOWN
        if (state, target) in LEGAL:
            out.append((extra, target, "append"))
        if state == target:
            out.append((extra + MERGE, target, "merge"))
        out += [(extra + INSERT, target, f"insert {NAMES[between]}") for between in (USER, ASSISTANT) if (state, between) in LEGAL and (between, target) in LEGAL]
    return out


BEST: dict[tuple[int, int], dict[int, tuple[int, str]]] = {}
for _role in range(4):
    for _state in range(4):
        _best: dict[int, tuple[int, str]] = {}
        for _cost, _new, _step in steps(_role, _state):
            if _new not in _best or _cost < _best[_new][0]:
                _best[_new] = (_cost, _step)
        BEST[_role, _state] = _best
#: Cost of ending in a state: a lone system turn gets an empty user turn.
END = {SYSTEM: INSERT, USER: 0, ASSISTANT: 0}
_COSTS = np.full((4, 4, 4), NEVER, dtype=np.int64)
for (_role, _state), _best in BEST.items():
    for _new, (_cost, _) in _best.items():
        _COSTS[_role, _state, _new] = _cost


def crossing(roles: list[int]) -> np.ndarray:
    """Least costs from each state before ``roles`` to each state after them."""
    d = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for r in roles:
        d = product(d, _COSTS[r])
    return d


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def forward(roles: Iterable[int], ahead: dict[int, int]) -> tuple[list[dict[int, tuple[int, int, int, str]]], dict[int, int]]:
    """Of every turn and state after it: cost so far, state before, cost, step; and the least cost of every state at the end. ``ahead`` has the costs before."""
    cost, back = ahead, []
    for r in roles:
        new: dict[int, tuple[int, int, int, str]] = {}
        for s in sorted(cost):
            for t, (c, step) in BEST[r, s].items():
                if t not in new or cost[s] + c < new[t][0]:
                    new[t] = (cost[s] + c, s, c, step)
        back.append(new)
        cost = {t: x[0] for t, x in new.items()}
    return back, cost


def trace(back: list[dict[int, tuple[int, int, int, str]]], last: int) -> tuple[int, list[tuple[int, int, str]]]:
    """The state before the first turn, and (state, cost, step) of every turn, of the path that ends in ``last``."""
    out, at = [], last
    for new in reversed(back):
        _, before, c, step = new[at]
        out.append((at, c, step))
        at = before
    return at, out[::-1]


def best_end(cost: dict[int, int]) -> int:
    return min((s for s in END if s in cost), key=lambda s: (cost[s] + END[s], s))


def solve(roles: tuple[int, ...]) -> list[tuple[int, int, str]]:
    """The path of a whole conversation."""
    back, cost = forward(roles, {START: 0})
    return trace(back, best_end(cost))[1]


solve_short = lru_cache(maxsize=1 << 16)(solve)


def escape(text: str) -> str:
    """The text with a backslash more in every ``<|``, so that it holds no control mark; :func:`unescape` takes it out."""
    return MARK.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(way: list[tuple[int, int, str]], roles: Iterable[int], texts: list[str], first: int, final: bool) -> tuple[str, str, int, int]:
    """Text, role sequence, cost and number of changed turns of a chunk. Open turns are closed by what follows."""
    out, names, total, changed, state = [], [], 0, 0, first
    for (new, c, step), text, role in zip(way, texts, roles, strict=True):
        total += c
        changed += step != "append" or new != role
        if step == "merge":
            out.append(f"\n\n{escape(text)}")
        else:
            if state != START:
                out.append("<|im_end|>\n")
            if step != "append":
                out.append(f"<|im_start|>{step[7:]}\n<|im_end|>\n")
                names.append(step[7:])
            out.append(f"<|im_start|>{NAMES[new]}\n{escape(text)}")
            names.append(NAMES[new])
        state = new
    if final:
        out.append("<|im_end|>\n")
        if state == SYSTEM:
            out.append("<|im_start|>user\n<|im_end|>\n")
            names.append("user")
            total += INSERT
            changed += 1
    return "".join(out), ",".join(names), total, changed


RESULT = "conv_id long, chunk long, n_turns long, roles string, cost long, n_changed long, rendered string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _groups(df: DataFrame, n_keys: int, schema: str, of: Callable[[tuple], Callable[[tuple], Iterator[tuple]]]) -> DataFrame:
    """Stream sorted rows by key: ``of(key)`` gives the function that takes a group's rows one by one, and None at its end, and yields rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, take = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_keys] != key:
                    if take:
                        out += take(None)
                    key = row[:n_keys]
                    take = of(key)
                out += take(row)
            yield _batch(out, schema)
        if take:
            yield _batch(list(take(None)), schema)

    return df.mapInArrow(run, schema)


def _whole(key: tuple) -> Callable:
    """Conversations of one chunk: rows conv_id, tie, role, text."""
    roles: list[int] = []
    texts: list[str] = []

    def take(row: tuple | None) -> Iterator[tuple]:
        if row is None:
            way = (solve_short if len(roles) <= 64 else solve)(tuple(roles))
            text, names, cost, changed = render(way, roles, texts, START, True)
            yield key[0], 0, len(roles), names, cost, changed, text
        else:
            roles.append(ROLES.get((row[2] or "").strip().lower(), 0))
            texts.append(row[3] or "")

    return take


def _long(rows: DataFrame, keys: list, chunk_turns: int, chunk_chars: int) -> DataFrame:
    """Conversations of several chunks."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, n, size = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            out = []
            for name, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != conv:
                    conv, n, size = name, 0, 0
                text = text or ""
                out.append((name, part, n, size, ROLES.get((role or "").strip().lower(), 0), text))
                n, size = n + 1, size + len(text)
            yield _batch(out, "conv long, part int, n long, size long, role int, text string")

    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_x8_id", "_x8_role", "_x8_text")
    turns = materialise(sorted_.mapInArrow(number, "conv long, part int, n long, size long, role int, text string"), "turns")
    # One row for each task that holds a part of a conversation.
    parts = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("k"), F.sum(F.char_length("text")).alias("c"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = parts.select("conv", "part", (F.sum("k").over(earlier) - F.col("k")).alias("k0"), (F.sum("c").over(earlier) - F.col("c")).alias("c0"))
    placed = turns.join(broadcast_if_small(materialise(before, "before"), 1_000_000), ["conv", "part"])
    placed = placed.select("conv", (F.floor((F.col("k0") + F.col("n")) / chunk_turns) + F.floor((F.col("c0") + F.col("size")) / chunk_chars)).alias("at"), (F.col("k0") + F.col("n")).alias("n"), "role", "text")

    def gather(key: tuple) -> Callable:
        roles: list[int] = []
        texts: list[str] = []

        def take(row: tuple | None) -> Iterator[tuple]:
            if row is None:
                yield *key, roles, texts, crossing(roles).ravel().tolist()
            else:
                roles.append(row[2])
                texts.append(row[3])

        return take

    gathered = placed.repartition("conv", "at").sortWithinPartitions("conv", "at", "n").select("conv", "at", "role", "text")
    chunks = materialise(_groups(gathered, 2, "conv long, at long, roles array<int>, texts array<string>, costs array<long>", gather), "chunks")

    def ahead(key: tuple) -> Callable:
        costs, chunk = np.where(np.arange(4) == START, 0, NEVER), 0

        def take(row: tuple | None) -> Iterator[tuple]:
            nonlocal costs, chunk
            if row is not None:
                yield row[0], row[1], chunk, costs.tolist()
                costs = np.minimum((costs[:, None] + np.array(row[2], dtype=np.int64).reshape(4, 4)).min(axis=0), NEVER)
                chunk += 1

        return take

    in_order = lambda df, last=False: df.repartition("conv").sortWithinPartitions("conv", F.desc("at") if last else "at")
    known = materialise(_groups(in_order(chunks.select("conv", "at", "costs")), 1, "conv long, at long, chunk long, ahead array<long>", ahead), "ahead")
    begins = lambda costs: {s: c for s, c in enumerate(costs) if c < NEVER}

    def begun(key: tuple) -> Callable:
        def take(row: tuple | None) -> Iterator[tuple]:
            if row is not None:
                back, cost = forward(row[2], begins(row[3]))
                yield row[0], row[1], [trace(back, t)[0] if t in cost else -1 for t in range(4)], [cost.get(t, NEVER) for t in range(4)]

        return take

    both = chunks.select("conv", "at", "roles").join(known, ["conv", "at"]).select("conv", "at", "roles", "ahead")
    maps = materialise(_groups(both, 2, "conv long, at long, begun array<long>, behind array<long>", begun), "maps")

    def ended(key: tuple) -> Callable:
        state = None

        def take(row: tuple | None) -> Iterator[tuple]:
            nonlocal state
            if row is not None:
                last = state is None
                state = best_end(begins(row[3])) if last else state
                yield row[0], row[1], state, int(last)
                state = row[2][state]

        return take

    ends = materialise(_groups(in_order(maps, True), 1, "conv long, at long, state int, last int", ended), "ends")

    def written(key: tuple) -> Callable:
        def take(row: tuple | None) -> Iterator[tuple]:
            if row is not None:
                _, _, roles, texts, costs, chunk, state, last = row
                first, way = trace(forward(roles, begins(costs))[0], state)
                text, names, cost, changed = render(way, roles, texts, first, bool(last))
                yield row[0], chunk, len(roles), names, cost, changed, text

        return take

    done = chunks.join(known, ["conv", "at"]).join(ends, ["conv", "at"]).select("conv", "at", "roles", "texts", "ahead", "chunk", "state", "last")
    return _groups(done, 2, RESULT, written)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_turns: int = CHUNK_TURNS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Repair and render conversations.

    Returns one row per chunk of a conversation: ``id_col, chunk`` (from 0),
    ``n_turns, roles, cost, n_changed, rendered``, with the chunk's part of
    the repaired role sequence, of the cost and of the rendered text; parts
    are joined in the order of ``chunk``. A chunk holds turns before which
    there are as many whole multiples of ``chunk_turns`` turns and of
    ``chunk_chars`` characters, so its place does not depend on how rows are
    dealt out, and a conversation of no more than both is one row. A turn is
    never cut: one very long text is a chunk's last.

    Turns are ordered by ``turn_col`` (null last), then role and text. A null
    or unknown role gets the cheapest one, a null text is empty, a row with a
    null id is a conversation of its own, repeated rows are merged turns like
    any others, and other columns are left out. In texts every ``<|`` gets a
    backslash (see :func:`escape`), so that none can open or close a turn.
    An empty table gives an empty result.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("_x8_id"), F.col(turn_col).alias("_x8_turn"), F.col(role_col).cast("string").alias("_x8_role"), F.col(text_col).cast("string").alias("_x8_text"))
    sizes = rows.where("_x8_id IS NOT NULL").groupBy("_x8_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("_x8_text")).alias("c"))
    large = materialise(sizes.where((F.col("n") > chunk_turns) | (F.col("c") > chunk_chars)).select("_x8_id"), "large")
    # The last two keys make rows of one conversation divisible, however many are equal.
    rows = rows.withColumn("_x8_hash", F.xxhash64("_x8_text")).withColumn("_x8_tie", F.monotonically_increasing_id())
    keys = [F.col("_x8_id"), F.asc_nulls_last("_x8_turn"), F.col("_x8_role"), F.col("_x8_hash"), F.col("_x8_tie")]
    small, some = rows, not large.isEmpty()
    if some:
        large = broadcast_if_small(large, 1_000_000)
        small = rows.join(large, "_x8_id", "left_anti")
    small = small.withColumn("_x8_own", F.when(F.col("_x8_id").isNull(), F.col("_x8_tie")))
    small = small.repartition("_x8_id", "_x8_own").sortWithinPartitions("_x8_id", "_x8_own", *keys[1:]).select("_x8_id", "_x8_own", "_x8_role", "_x8_text")
    out = _groups(small, 2, RESULT, _whole)
    if some:
        out = out.union(_long(rows.join(large, "_x8_id", "left_semi"), keys, chunk_turns, chunk_chars))
    return out.withColumnRenamed("conv_id", id_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
