"""Bounded-space online packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.llm.words import ByteIds, PartTable, Ragged, slices
from causalbars.plans.staging import stage

class IdTable(PartTable):
    """Ids of texts as little-endian 32-bit bytes, as the tokenizer gives them for whole texts without adding special tokens."""

    def __init__(self, path: str, words: int = 250_000):
        self.tokenizer = ByteIds(path, plain=False)
        self.added = self.tokenizer.added()
        super().__init__("", words)

    def forget(self) -> None:
        super().forget()
        self.ids = Ragged(np.uint32)

    def learn(self, parts: list[str]) -> None:
        self.ids.append(self.tokenizer.encode(parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text that holds an added token is encoded whole, since the token may stand across parts."""
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        codes, sizes = self.split(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        ids, length = self.ids.take(codes)
        ends = np.cumsum(np.add.reduceat(length, np.cumsum(sizes) - sizes)) * 4
        raw = ids.astype("<u4").tobytes()
        out = [raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in whole:
            out[i] = np.array(self.tokenizer.whole(texts[i]), "<u4").tobytes()
        return out


class Packer:
    """At most ``windows`` sequences are open; an item goes where it leaves the least room.

    If it fits nowhere and all are open, the fullest is emitted: topped up with the head of the item where ``least`` tokens
    or more are free, else padded.  An item is (key, start, doc_tokens, ids); ``emit`` gets a finished
    sequence as a list of items.
    """

    def __init__(self, length: int, windows: int, least: int):
        self.length, self.windows, self.least = length, windows, least
        self.open: list[list] = []  # [free, items]
        self.done: list[list[tuple]] = []

    def add(self, item: tuple) -> None:
        key, start, total, ids = item
        size = len(ids) // 4
        while size >= self.length:
            self.done.append([(key, start, total, ids[: 4 * self.length])])
            ids, start, size = ids[4 * self.length :], start + self.length, size - self.length
        if not size:
            return
        best = min((w for w in self.open if w[0] >= size), key=lambda w: w[0], default=None)
        if best is None and len(self.open) == self.windows:
            best = min(self.open, key=lambda w: w[0])
            if best[0] >= self.least:
                head = 4 * best[0]
                best[1].append((key, start, total, ids[:head]))
                ids, start, size = ids[head:], start + best[0], size - best[0]
            self.done.append(best[1])
            self.open.remove(best)
            best = None
            if size and any(w[0] >= size for w in self.open):
                best = min((w for w in self.open if w[0] >= size), key=lambda w: w[0])
        if best is None:
            best = [self.length, []]
            self.open.append(best)
        best[0] -= size
        best[1].append((key, start, total, ids))
        if not best[0]:
            self.done.append(best[1])
            self.open.remove(best)

    def finished(self) -> list[list[tuple]]:
        done, self.done = self.done, []
        return done

    def close(self) -> list[list[tuple]]:
        """Merge the open windows: full sequences, the rest cut to powers of two, which need no padding."""
        items = [i for w in sorted(self.open, key=lambda w: w[0]) for i in w[1]]
        self.open = []
        left = sum(len(i[3]) for i in items) // 4
        out, items = [], items[::-1]
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                key, start, total, ids = items.pop()
                take = min(room, len(ids) // 4)
                window.append((key, start, total, ids[: 4 * take]))
                if 4 * take < len(ids):
                    items.append((key, start + take, total, ids[4 * take :]))
                room -= take
            out.append(window)
        return out


def _columns(sequences: Iterable[list[tuple]], first: int | None, group: int) -> dict[str, list]:
    """Rows of pieces; ``first`` numbers the sequences, None marks windows that stay open."""
    rows: dict[str, list] = {c: [] for c in ("key", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset", "part")}
    for n, items in enumerate(sequences):
        at = 0
        for key, start, total, ids in items:
            size = len(ids) // 4
            values = (key, start, size, ids, total, None if first is None else first + n, at, group)
            for column, value in zip(rows.values(), values, strict=True):
                column.append(value)
            at += size
    return rows


def _repack(
    schema: T.StructType, level: int, last: bool, sizes: tuple[int, int, int], merge: int
) -> Callable[[pa.Table], pa.Table]:
    """Packs the leftovers of one group of tasks; the last group is closed."""

    def again(left: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        group, packer = left.column("part")[0].as_py() // merge, Packer(*sizes)
        for row in left.sort_by([("part", "ascending"), ("order", "ascending")]).to_pylist():
            packer.add((row["key"], row["start"], row["doc_tokens"], row["token_ids"]))
        finished = packer.finished() + (packer.close() if last else [])
        rows = [_columns(finished, _base(level, group), group), _columns([w[1] for w in packer.open], None, group)]
        return pa.concat_tables(pa.Table.from_pydict(r, schema=to_arrow_schema(schema)) for r in rows)

    return again


def _base(level: int, group: int) -> int:
    return (level << 58) + (group << 30)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    windows: int = 64,
    end_id: int = 1,
    least: int = 32,
    merge: int = 16,
) -> DataFrame:
    """Pieces of all documents placed in sequences: key, start, length, token_ids, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file on every executor.  A document is its ids and ``end_id``; token_ids holds
    a piece's ids as little-endian unsigned 32-bit numbers.  Each task packs what it reads with ``windows`` open sequences
    (``Packer``), so its memory does not grow with the input.  What is still open at a task's end goes on:
    the leftovers of ``merge`` tasks are packed together, then those of ``merge`` such groups, until one is left.
    Only leftovers are shuffled, at most ``windows`` sequences a task.

    Padding is below ``least`` tokens a sequence, and none at all in the last ones, whose lengths are powers of two.  A document is cut
    only where it is longer than a sequence or tops up one that is emitted.

    A null or empty text is ``end_id`` alone; repeated rows and null keys are packed as they come; an empty
    table gives no rows; other input columns are ignored.
    """
    kind = docs.schema[key].dataType
    fields = [("key", kind), ("start", T.LongType()), ("length", T.LongType()), ("token_ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("part", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part = TaskContext.get().partitionId()
        encoder, packer, n = _encoder(tokenizer), Packer(length, windows, least), 0

        def out(done: list[list[tuple]], first: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(_columns(done, first, part), schema=arrow)

        for batch in batches:
            for some in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), 1_000_000):
                keys, texts = (batch.column(i).slice(some.start, some.stop - some.start).to_pylist() for i in range(2))
                for k, i in zip(keys, encoder.encode([t or "" for t in texts]), strict=True):
                    packer.add((k, 0, len(i) // 4 + 1, i + end))
                if done := packer.finished():
                    yield out(done, _base(0, part) + n)
                    n += len(done)
        yield out([w[1] for w in packer.open], None)

    pieces = stage(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(pack, schema), "pieces")
    done = [pieces.where("sequence_id is not null")]
    left = pieces.where("sequence_id is null")
    parts = left.agg(F.max("part")).first()[0]
    level = 0
    while parts is not None:
        level += 1
        last = parts < merge

        ordered = left.withColumn("order", F.monotonically_increasing_id())
        again = _repack(schema, level, last, (length, windows, least), merge)
        again_packed = ordered.groupBy(F.floor(F.col("part") / merge)).applyInArrow(again, schema)
        merged = stage(again_packed, f"pieces-{level}")
        done.append(merged.where("sequence_id is not null"))
        left = merged.where("sequence_id is null")
        parts = None if last else left.agg(F.max("part")).first()[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key").alias(key), "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset")


_ENCODERS: dict[str, IdTable] = {}


def _encoder(path: str) -> IdTable:
    """One per worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdTable(path)
    return _ENCODERS[path]
