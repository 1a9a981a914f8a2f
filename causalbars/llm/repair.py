"""Cheapest repair of the structure of conversations, by dynamic programming with square-root checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Its state is what was said last: nothing, a system turn, a user
turn or an assistant turn.  Backward vectors hold the cost from each state to the end.  They are kept at
checkpoints only, some square root of the turns apart; walking forward, the vectors between two checkpoints are computed again and
the ASCII-least edit that still leads to the cheapest end is taken.

The same scheme splits one very long conversation over tasks.  A block of turns is a (min, +) matrix of four states; the matrices,
composed from the end, give the vectors at the blocks' borders; with these each block says where it leads from every
state, which gives its state at the start.  Then all blocks are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.plans.series import numbered
from causalbars.plans.staging import stage

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States and what may be said next: in START a system turn too.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 50
#: Cost from each state after the last turn: only nothing or an assistant turn may end a conversation.
END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]


def step_back(v: Vector, kind: int) -> Vector:
    """Costs before a turn from those after it.  ``kind`` is 3 * initial (s, u, a, other) + fault (none, truncated, to be deleted)."""
    start, system, user, assistant = v
    initial, fault = divmod(kind, 3)
    b0, b1, b2, b3 = start + DELETE, system + DELETE, user + DELETE, assistant + DELETE
    if fault < 2:
        kept = TRUNCATED if fault else 0
        to_user, to_assistant = user + kept, assistant + kept
        if initial == 0:
            b0 = min(b0, system + kept)
        changed = to_user + (0 if initial == 1 else REROLE)
        b0, b1, b3 = min(b0, changed), min(b1, changed), min(b3, changed)
        b2 = min(b2, to_assistant + (0 if initial == 2 else REROLE))
    # Turns put in before this one.
    twice = min(b2 + INSERT, b3 + 2 * INSERT)
    return min(b0, twice), min(b1, twice), min(b2, b3 + INSERT), min(b3, b2 + INSERT)


def _checkpoints(kinds: bytes, end: Vector) -> tuple[int, list[Vector]]:
    """The distance of checkpoints, and the vectors at 0, 1, 2, ... times that distance."""
    every = isqrt(len(kinds)) + 1
    held, v = [], end
    for i in range(len(kinds) - 1, -1, -1):
        v = step_back(v, kinds[i])
        if i % every == 0:
            held.append(v)
    return every, held[::-1]


def walk(kinds: bytes, end: Vector, state: int) -> tuple[list[tuple[int, str, int, int]], int]:
    """Edits (turn, edit, state reached, cost) from ``state`` on, and the last state.  ``end`` holds the costs behind the turns.

    A turn put in has the place of the turn that it stands before.  Of edits that are equally cheap to the end the least letter is taken.
    """
    every, held = _checkpoints(kinds, end)
    edits = []
    for block, first in enumerate(held):
        low, high = block * every, min((block + 1) * every, len(kinds))
        v = held[block + 1] if block + 1 < len(held) else end
        inner = [v]
        for i in range(high - 1, low, -1):
            inner.append(v := step_back(v, kinds[i]))
        inner.append(first)
        for i in range(low, high):
            here, after = inner[high - i], inner[high - i - 1]
            initial, fault = divmod(kinds[i], 3)
            kept = (0, TRUNCATED, _FAR)[fault]
            while True:
                to = _NEXT[state]
                left = here[state]
                if after[state] + DELETE == left:
                    edits.append((i, "D", state, DELETE))
                    break
                if here[to] + INSERT == left:
                    edits.append((i, "I", to, INSERT))
                    state = to
                    continue
                keep = SYSTEM if state == START and initial == 0 else to if initial == to - 1 else None
                if keep is not None and after[keep] + kept == left:
                    edits.append((i, "K", keep, kept))
                    state = keep
                else:
                    edits.append((i, "R", to, kept + REROLE))
                    state = to
                break
    return edits, state


def walk_end(n: int, state: int) -> list[tuple[int, str, int, int]]:
    """Turns put in behind the last of ``n``."""
    edits = []
    while END[state]:
        state = _NEXT[state]
        edits.append((n, "I", state, INSERT))
    return edits


def _matrix(kinds: bytes) -> list[int]:
    """Cost from every state before the turns to every state behind them, row by row; turns put in behind them belong to what follows."""
    columns = []
    for to in range(4):
        v = tuple(0 if q == to else _FAR for q in range(4))
        for kind in reversed(kinds):
            v = step_back(v, kind)
        columns.append(v)
    return [columns[to][q] for q in range(4) for to in range(4)]


@dataclass
class Repair:
    """``conversations``: one row each, with counts and cost; ``edits``: all edits in order (at, step), with the turn they give.

    An edit's role and text are those of the repaired turn; text is null for a deleted one.
    """

    conversations: DataFrame
    edits: DataFrame


_SPACES = " \t\n\x0b\x0c\r"


def repair_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_per_block: int = 65_536
) -> Repair:
    """Faults of all conversations, and the cheapest edits that give each the role initials ``(s?(ua)+)?``.

    Turns stand in the order of ``turn`` (nulls first), then role and text.  A turn is blank (no character but white space), else
    duplicate (role and text seen earlier in the conversation), else truncated (last such character none of ``.!?``) or sound.
    Keep costs 0, rerole to user or assistant 1, delete 2 (the only edit of blank and duplicate turns), an empty turn put in 5; a truncated turn that is
    not deleted costs 5 more.  Of edits of equal cost the string of letters D, I, K, R that is ASCII-least is taken.

    conversations: _c (unique), key, gaps (turn numbers missing between the least and the greatest; null if beyond 64 bits), blank,
    duplicate, truncated, illegal (neighbouring role initials other than su, ua, au), cost.  edits: _c, at, step, edit, role, text, cost.

    A conversation of more than ``rows_per_block`` turns is cut into blocks of that many turns, or of the square root of
    its turns if that is more; a task holds one block, or the matrices of one conversation's blocks.

    Null roles and texts count as one space; null keys are one conversation; equal rows are duplicates; an empty
    table gives empty results; other columns are ignored.
    """
    kind = turns.schema[key].dataType
    rows = turns.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    rows = stage(numbered(rows, ["key", "turn", "role", "text"], "n"), "turns")
    firsts = stage(rows.groupBy("key").agg(F.min("n").alias("_c"), F.count(F.lit(1)).alias("_size")), "conversations")
    seen = F.rtrim(F.translate("text", _SPACES, " " * len(_SPACES)))
    initial = F.substring("role", 1, 1)
    length = F.greatest(F.lit(rows_per_block), F.ceil(F.sqrt("_size")))
    placed = rows.join(firsts.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key"))).select(
        "_c",
        "n",
        "turn",
        (F.col("n") - F.col("_c")).alias("at"),
        F.floor((F.col("n") - F.col("_c")) / length).alias("block"),
        (F.col("_size") > length).alias("split"),
        F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, "sua")), initial).cast("int"), F.lit(0)), F.lit(4)).alias("initial"),
        (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("open"),
        F.xxhash64("role", "text").alias("_h1"),
        F.xxhash64(F.lit(1), "text", "role").alias("_h2"),
    )
    placed = stage(placed, "placed")
    # The first of equal turns is found by an aggregate and told by its number, so a much repeated turn is no join key.
    first = placed.where("not blank").groupBy("_c", "_h1", "_h2").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("_first"))
    fault = F.when(F.col("blank"), 3).when(F.col("_first").isNull(), 2).when(F.col("open"), 1).otherwise(0)
    judged = placed.join(first, "n", "left").withColumn("fault", fault)
    judged = judged.withColumn("kind", (3 * (F.col("initial") - 1) + F.least("fault", F.lit(2))).cast("int"))
    judged = stage(judged.select("_c", "n", "turn", "at", "block", "split", "initial", "fault", "kind"), "judged")

    edits = stage(_walked(judged), "edits")
    said = rows.select("n", F.col("role").alias("_role"), F.col("text").alias("_text"))
    put_in = edits.where("n is null").select("_c", "at", "step", "edit", "role", F.lit("").alias("text"), "cost")
    told = edits.join(said, "n").select(
        "_c", "at", "step", "edit", F.coalesce("role", "_role").alias("role"), F.when(F.col("edit") != "D", F.col("_text")).alias("text"), "cost"
    )
    counts = judged.groupBy("_c").agg(*[F.count_if(F.col("fault") == f).alias(n) for n, f in (("blank", 3), ("duplicate", 2), ("truncated", 1))])
    moments = judged.where("turn is not null").groupBy("_c", "turn").agg(F.lit(1).alias("_one"))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count(F.lit(1))
    gaps = moments.groupBy("_c").agg(span.alias("_gaps")).select("_c", F.expr("try_cast(_gaps AS bigint)").alias("gaps"), F.lit(True).alias("_timed"))
    before = judged.select((F.col("n") + 1).alias("n"), F.col("_c").alias("_c0"), F.col("initial").alias("_i0"))
    pair = 10 * F.col("_i0") + F.col("initial")
    illegal = judged.join(before, "n").where((F.col("_c") == F.col("_c0")) & ~pair.isin(12, 23, 32)).groupBy("_c").agg(F.count(F.lit(1)).alias("illegal"))
    cost = edits.groupBy("_c").agg(F.sum("cost").alias("cost"))
    out = firsts.join(counts, "_c").join(gaps, "_c", "left").join(illegal, "_c", "left").join(cost, "_c")
    return Repair(
        out.select(
            "_c",
            F.col("key").cast(kind).alias(key),
            F.when(F.col("_timed"), F.col("gaps")).otherwise(0).alias("gaps"),
            "blank",
            "duplicate",
            "truncated",
            F.coalesce("illegal", F.lit(0)).alias("illegal"),
            "cost",
        ),
        told.unionByName(put_in),
    )


_EDITS = "_c bigint, at bigint, step int, n bigint, edit string, role string, cost bigint"
_BORDERS = "_c bigint, block bigint, after array<bigint>, state int, final boolean"


def _walked(judged: DataFrame) -> DataFrame:
    """All edits.  Blocks of split conversations first get the costs behind them and the state they start from."""
    borders = _borders(judged)
    turns = judged.select("_c", "block", "at", "n", "kind")
    if borders is None:
        turns = turns.select("*", F.lit(None).cast("array<bigint>").alias("after"), F.lit(START).alias("state"), F.lit(True).alias("final"))
    else:
        turns = turns.join(borders, ["_c", "block"], "left")
    n = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "_c", "block").sortWithinPartitions("_c", "block", "at").mapInArrow(_edit_blocks, _EDITS)


def _borders(judged: DataFrame) -> DataFrame | None:
    """after, state and final of every block of the split conversations, or None if there is none."""
    split = judged.where("split").select("_c", "block", "at", "kind")
    if split.isEmpty():
        return None
    costs_type, states_type = pa.list_(pa.int64()), pa.list_(pa.int32())

    def kinds(block: pa.Table) -> bytes:
        return bytes(block.sort_by("at").column("kind").to_pylist())

    def one(block: pa.Table, **columns: pa.Array) -> pa.Table:
        return pa.table({"_c": block.column("_c").slice(0, 1), "block": block.column("block").slice(0, 1), **columns})

    def matrix(block: pa.Table) -> pa.Table:
        return one(block, costs=pa.array([_matrix(kinds(block))], costs_type))

    def vectors(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by([("block", "descending")])
        v, out = list(END), []
        for costs in blocks.column("costs").to_pylist():
            out.append(v)
            v = [min(costs[4 * q + to] + v[to] for to in range(4)) for q in range(4)]
        final = pa.array([i == 0 for i in range(len(out))])
        return pa.table({"_c": blocks.column("_c"), "block": blocks.column("block"), "after": pa.array(out, costs_type), "final": final})

    def exits(block: pa.Table) -> pa.Table:
        after, each = block.column("after")[0].as_py(), kinds(block)
        found = [walk(each, tuple(after), q)[1] for q in range(4)]
        return one(block, after=pa.array([after], costs_type), exits=pa.array([found], states_type), final=block.column("final").slice(0, 1))

    def states(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        state, out = START, []
        for to in blocks.column("exits").to_pylist():
            out.append(state)
            state = to[state]
        return blocks.select(["_c", "block", "after"]).append_column("state", pa.array(out, pa.int32())).append_column("final", blocks.column("final"))

    ids = "_c bigint, block bigint"
    costs = stage(split.groupBy("_c", "block").applyInArrow(matrix, f"{ids}, costs array<bigint>"), "matrices")
    after = stage(costs.groupBy("_c").applyInArrow(vectors, f"{ids}, after array<bigint>, final boolean"), "vectors")
    found = split.join(after, ["_c", "block"]).groupBy("_c", "block").applyInArrow(exits, f"{ids}, after array<bigint>, exits array<int>, final boolean")
    return stage(stage(found, "exits").groupBy("_c").applyInArrow(states, _BORDERS), "borders")


def _edit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of blocks, whose turns come one after the other; one block is held.  Without borders a block is a whole conversation."""
    number, letters = pa.int64(), pa.string()
    schema = pa.schema({"_c": number, "at": number, "step": pa.int32(), "n": number, "edit": letters, "role": letters, "cost": number})
    out: list[list] = [[] for _ in schema]
    block: tuple | None = None
    kinds, numbers = bytearray(), []

    def close() -> None:
        c, _, first, after, state, final = block
        edits, state = walk(bytes(kinds), END if after is None else tuple(after), state or START)
        if final is not False:
            edits += walk_end(len(kinds), state)
        step, place = 0, -1
        for i, edit, to, cost in edits:
            step, place = (step + 1 if i == place else 0), i
            values = (c, first + i, step, None if edit == "I" else numbers[i], edit, _ROLE[to] if edit in "IR" else None, cost)
            for column, value in zip(out, values, strict=True):
                column.append(value)

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for c, b, at, n, kind, after, state, final in zip(*[columns[k] for k in ("_c", "block", "at", "n", "kind", "after", "state", "final")], strict=True):
            if block is None or (c, b) != block[:2]:
                if block is not None:
                    close()
                block, kinds, numbers = (c, b, at, after, state, final), bytearray(), []
            kinds.append(kind)
            numbers.append(n)
        yield batch_of()
        out = [[] for _ in schema]
    if block is not None:
        close()
        yield batch_of()


def digests(edits: DataFrame) -> DataFrame:
    """_c, audit (letters of all edits), repaired_sha256 (repaired ``role:text`` joined by line breaks) of every conversation.

    The hash of a conversation reads its lines in order, so they pass one task as a stream, which holds the letters only.
    """
    n = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = edits.select("_c", "at", "step", "edit", F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).alias("line"))
    return lines.repartition(n, "_c").sortWithinPartitions("_c", "at", "step").mapInArrow(_digest, "_c bigint, audit string, repaired_sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, letters, lines, total = None, [], 0, sha256()
    done: list[tuple] = []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], t) for i, (n, t) in enumerate((("_c", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())))})

    for batch in batches:
        for c, edit, line in zip(batch.column("_c").to_pylist(), batch.column("edit").to_pylist(), batch.column("line"), strict=True):
            if c != now:
                if now is not None:
                    done.append((now, "".join(letters), total.hexdigest()))
                now, letters, lines, total = c, [], 0, sha256()
            letters.append(edit)
            if line.is_valid:
                total.update((b"\n" if lines else b"") + line.as_py().encode())
                lines += 1
        yield rows()
        done = []
    if now is not None:
        done.append((now, "".join(letters), total.hexdigest()))
        yield rows()
