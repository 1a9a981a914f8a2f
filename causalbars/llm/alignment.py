"""Alignment of two tokenizers on the same texts by an associative monoid of fragments.

A fragment stands for a range of a text's bytes: tokens up to the first offset where both tokenizers end one (open
prefix), the groups closed behind it, and the tokens after the last such offset (open suffix).  Fragments of neighbouring
ranges compose, whatever the order of composition: what stands open between them is matched again by byte offsets.

Words are fragments that compose by joining, because both tokenizers end a token with them, so each different word is
aligned once.  Very long texts are cut into byte ranges that become rows of their own.  There each
tokenizer starts and ends a range at the next place where it can, so a range's two token lists need not meet at its
borders; a tree reduction over Spark tasks composes the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.llm.words import _CUT, ByteIds, Grown, PartTable, PieceIds, Ragged, flatten, slices
from causalbars.plans.staging import stage

_PAIR = 32  # a link is one number: A's id above, B's id below


@dataclass
class Tokens:
    """Tokens of both sides, with the byte offsets where they end."""

    a: list[int] = field(default_factory=list)
    a_end: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    b_end: list[int] = field(default_factory=list)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(self.a + other.a, self.a_end + other.a_end, self.b + other.b, self.b_end + other.b_end)

    def groups(self) -> tuple[list[tuple[list[int], list[int]]], Tokens]:
        """Groups up to each common end, and what stands after the last."""
        out, i, j, ai, bj = [], 0, 0, 0, 0
        while i < len(self.a_end) and j < len(self.b_end):
            if self.a_end[i] < self.b_end[j]:
                i += 1
            elif self.a_end[i] > self.b_end[j]:
                j += 1
            else:
                i, j = i + 1, j + 1
                out.append((self.a[ai:i], self.b[bj:j]))
                ai, bj = i, j
        return out, Tokens(self.a[ai:], self.a_end[ai:], self.b[bj:], self.b_end[bj:])


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


@dataclass
class Fragment:
    """``cut`` is false while no common end was found; then ``head`` holds all tokens.  Closed groups are text and links."""

    head: Tokens
    cut: bool = False
    closed: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    tail: Tokens = field(default_factory=Tokens)

    @staticmethod
    def of(tokens: Tokens) -> Fragment:
        groups, rest = tokens.groups()
        if not groups:
            return Fragment(tokens)
        n, m = len(groups[0][0]), len(groups[0][1])
        head = Tokens(tokens.a[:n], tokens.a_end[:n], tokens.b[:m], tokens.b_end[:m])
        return Fragment(head, True, *_close(groups[1:]), rest)

    def __add__(self, other: Fragment) -> Fragment:
        middle = Fragment.of((self.tail if self.cut else self.head) + other.head)
        if not self.cut:
            if not other.cut:
                return middle
            # The common end of ``other`` ends the middle, which leaves nothing open.
            return Fragment(middle.head, True, middle.closed + other.closed, middle.links + other.links, other.tail)
        if not middle.cut:
            return Fragment(self.head, True, self.closed, self.links, middle.head)
        text, links = _close([(middle.head.a, middle.head.b)])
        text, links = self.closed + text + middle.closed, self.links + links + middle.links
        if not other.cut:
            return Fragment(self.head, True, text, links, middle.tail)
        return Fragment(self.head, True, text + other.closed, links + other.links, other.tail)

    def finish(self) -> tuple[str, int, list[int]]:
        """Text of all groups, their number and links of a whole text."""
        text, links = _close([(self.head.a, self.head.b)])
        text = text + self.closed
        return ";".join(text), sum(t.count(";") + 1 for t in text), links + self.links


def _close(groups: list[tuple[list[int], list[int]]]) -> tuple[list[str], list[int]]:
    """Text of groups in one piece, and the link at the end of each."""
    if not groups:
        return [], []
    return [";".join([group_text(a, b) for a, b in groups])], [a[-1] << _PAIR | b[-1] for a, b in groups]


class Encoders:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteIds(a_path, plain=True), PieceIds(b_path)
        self.a_bytes, self.b_bytes = self.a.bytes_of(), self.b.bytes_of()
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # Every id with the sign that follows it: A's within and at the end of a group, then B's.
        self.names = [f"{i}{sign}" for side, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(side))]

    def a_text(self, ids: list[int]) -> bytes:
        return b"".join([self.a_bytes[i] for i in ids])

    def b_text(self, ids: list[int]) -> bytes:
        return b"".join([self.b_bytes[i] for i in ids])


class WordFragments(PartTable):
    """The closed groups of every word."""

    def __init__(self, encoders: Encoders, words: int = 100_000):
        self.encoders = encoders
        super().__init__(" ", words)

    def forget(self) -> None:
        super().forget()
        self.n_a, self.n_b, self.n_groups, self.sound = Grown(np.int32), Grown(np.int32), Grown(np.int32), Grown(bool)
        self.text: list[str] = []
        self.links = Ragged(np.int32)
        self.pairs: dict[int, int] = {}

    def learn(self, parts: list[str]) -> None:
        """Align all parts at once: one after the other they are one text, in which both tokenizers end a token with each."""
        e = self.encoders
        (a, n_a), (b, n_b) = flatten(e.a.encode(parts)), flatten(e.b.encode(parts))
        size = pc.binary_length(pa.array(parts, pa.large_string())).to_numpy()
        sound = self._sound(parts, size, a, n_a, b, n_b)
        a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
        a_end, b_end = np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_last, b_last = np.searchsorted(a_end, common), np.searchsorted(b_end, common)
        # Tokens by group, those of A first; a name holds the sign behind a token.
        name = np.concatenate([a, b + 2 * len(e.a_size)])
        name[a_last] += len(e.a_size)
        name[len(a) + b_last] += len(e.b_size)
        ordered = name[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]
        names = list(map(e.names.__getitem__, ordered.tolist()))
        ends = np.cumsum(np.where(sound, n_a + n_b, 0)).tolist()
        self.text += ["".join(names[start:end])[:-1] for start, end in zip([0, *ends], ends, strict=False)]
        n_groups = np.diff(np.searchsorted(common, np.cumsum(np.where(sound, size, 0)), "right"), prepend=0)
        link, at = np.unique(a[a_last] << _PAIR | b[b_last], return_inverse=True)
        number = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in link.tolist()], np.int64)
        self.links.extend(number[at], n_groups)
        for column, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.sound, sound)):
            column.extend(values)

    def _sound(self, parts: list[str], size: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which parts both tokenizers give back byte by byte."""
        e, raw, sound = self.encoders, "".join(parts).encode(), np.ones(len(parts), bool)
        for ids, n, sizes, text in ((a, n_a, e.a_size, e.a_text), (b, n_b, e.b_size, e.b_text)):
            ends = np.cumsum(n)
            long = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[ends], prepend=0)
            if not (long == size).all() or text(ids.tolist()) != raw:
                for i, (start, end) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                    sound[i] &= text(ids[start:end].tolist()) == parts[i].encode()
        return sound

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray | pa.Array]:
        """Result columns of texts that are not empty."""
        codes, sizes = self.split(texts)
        starts = np.cumsum(sizes) - sizes
        sound = np.logical_and.reduceat(self.sound.view()[codes], starts)
        out = {n: np.where(sound, np.add.reduceat(c.view()[codes], starts, dtype=np.int64), 0) for n, c in (("n_a", self.n_a), ("n_b", self.n_b), ("n_groups", self.n_groups))}
        at, text = codes.tolist(), self.text.__getitem__
        out["groups"] = [";".join(map(text, at[s : s + n])) if good else "" for s, n, good in zip(starts.tolist(), sizes.tolist(), sound.tolist(), strict=True)]
        # Links of each text, equal ones counted.
        flat, length = self.links.take(codes)
        text_of = np.repeat(np.repeat(np.arange(len(texts)), sizes), length)
        keep = sound[text_of]
        key, count = np.unique(text_of[keep] * len(self.pairs) + flat[keep], return_counts=True)
        offsets = np.searchsorted(key, np.arange(len(texts) + 1) * len(self.pairs)).astype(np.int32)
        names = np.fromiter(self.pairs, np.int64, len(self.pairs))
        pairs = names[key % len(self.pairs)] if len(key) else np.zeros(0, np.int64)
        out["links"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs))
        out["counts"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(count.astype(np.int64)))
        return out


_RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<bigint>, counts array<bigint>"
_TOKENS = "struct<a:array<bigint>,a_end:array<bigint>,b:array<bigint>,b_end:array<bigint>>"
_PARTS = "_row bigint, _chunk bigint, a_start bigint, a_part binary, b_start bigint, b_part binary"
_FRAGMENT = (
    "_row bigint, _chunk bigint, sound boolean, n_a bigint, n_b bigint, cut boolean, closed string, links array<bigint>, "
    f"head {_TOKENS}, tail {_TOKENS}"
)
_MEMORY: dict[tuple[str, str], WordFragments] = {}


def _words(a_path: str, b_path: str) -> WordFragments:
    """One per worker process, kept between its tasks."""
    if (a_path, b_path) not in _MEMORY:
        _MEMORY[a_path, b_path] = WordFragments(Encoders(a_path, b_path))
    return _MEMORY[a_path, b_path]


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", chunk: int = 1 << 16, fan: int = 16
) -> DataFrame:
    """Groups of tokens of both tokenizers that end at the same bytes of every text, and the links between them.

    ``a_path`` is a byte-level BPE file and ``b_path`` a piece model, both on every executor; A encodes a space and the text, B
    the text, before which it puts that space.  Returned per row of ``docs``: _row (unique), key, n_a and n_b (tokens),
    n_groups, n_links (one at the end of each group), groups (``a1,a2|b1;a3|b2,b3``), and ``links`` with ``counts``: the
    different id pairs that are linked (A's id * 2^32 + B's id) and how often.

    Texts of more than ``chunk`` bytes are cut into ranges of that size, spread over tasks, and composed ``fan`` at a time.
    A text without any space is one range.  A text's groups are one value, as the text itself is.

    A null or empty text has no tokens, nor has one that a tokenizer does not give back byte by byte: zeros, and empty text and lists.
    Repeated rows and null keys are aligned as they come; an empty table gives no rows; other input columns are ignored.
    """
    schema = _keyed(docs, key, _RESULT)
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    is_long = F.coalesce(F.octet_length("_text") > chunk, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, words = to_arrow_schema(schema), _words(a_path, b_path)
        for batch in batches:
            keys = batch.column(0)
            for some in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), 400_000):
                texts = batch.column(1).slice(some.start, some.stop - some.start).to_pylist()
                full = np.array([bool(t) for t in texts])
                found = _spread(words.align([t for t in texts if t]), full) if full.any() else _nothing(len(full))
                found["n_links"] = found["n_groups"]
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([keys[some.start : some.stop].cast(arrow.field(0).type), *[pa.array(found[f.name], f.type) if not isinstance(found[f.name], pa.Array) else found[f.name].cast(f.type) for f in list(arrow)[1:]]], schema=arrow)

    done = rows.where(~is_long).mapInArrow(whole, schema)
    composed = _long(rows.where(is_long), a_path, b_path, key, chunk, fan)
    if composed is not None:
        done = done.unionByName(composed.mapInArrow(_finish(schema, key), schema))
    return stage(done.withColumn("_row", F.monotonically_increasing_id()), "aligned", row_group_mb=16)


def _keyed(rows: DataFrame, key: str, fields: str) -> T.StructType:
    return T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(fields).fields])


def _nothing(n: int) -> dict[str, list]:
    return {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "groups": [""] * n, "links": [[]] * n, "counts": [[]] * n}


def _spread(found: dict, full: np.ndarray) -> dict:
    """Results of the texts that are not empty, at their places among all."""
    if full.all():
        return found
    at = np.cumsum(full) - 1
    out = {}
    for name, values in found.items():
        if name in ("links", "counts"):
            offsets = np.concatenate([[0], values.offsets.to_numpy()[1:][np.maximum(at, 0)] * (at >= 0)]).astype(np.int32)
            out[name] = pa.ListArray.from_arrays(pa.array(offsets), values.values)
        elif name == "groups":
            out[name] = [values[i] if f else "" for i, f in zip(at.tolist(), full.tolist(), strict=True)]
        else:
            out[name] = np.where(full, values[np.maximum(at, 0)], 0)
    return out


#: Places before which A or B always ends a token.
_A_CUT, _B_CUT = re.compile(rb"(?<=[!-~])[ \n]"), re.compile(rb"(?<=[!-~]) ")


def _ranges(data: bytes, chunk: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """For each range of bytes, start and bytes of A's and of B's part."""

    def cut(pattern: re.Pattern, at: int) -> int:
        found = pattern.search(data, at) if at < len(data) else None
        return 0 if not at else found.start() if found else len(data)

    last_a = last_b = 0
    for high in range(chunk, len(data) + chunk, chunk):
        next_a, next_b = cut(_A_CUT, high), cut(_B_CUT, high)
        yield last_a, data[last_a:next_a], last_b, data[last_b:next_b]
        last_a, last_b = next_a, next_b


def _long(rows: DataFrame, a_path: str, b_path: str, key: str, chunk: int, fan: int) -> DataFrame | None:
    """One composed fragment for every long text, or None if there is no such text."""
    parts, schema = _keyed(rows, key, _PARTS), _keyed(rows, key, _FRAGMENT)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(parts)
        for batch in batches:
            for k, text, row in zip(*[batch.column(i) for i in range(3)], strict=True):
                for n, found in enumerate(_ranges(f" {text.as_py()}".encode(), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k.as_py(), row.as_py(), n, *found), arrow, strict=True)], schema=arrow)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, e = to_arrow_schema(schema), _words(a_path, b_path).encoders
        for batch in batches:
            for row in batch.to_pylist():
                a = [*chain.from_iterable(e.a.encode(_CUT.split(row["a_part"].decode())))]
                b = [*chain.from_iterable(e.b.encode(_CUT.split(row["b_part"].decode())))]
                sound = e.a_text(a) == row["a_part"] and e.b_text(b) == row["b_part"]
                tokens = Tokens(a, (row["a_start"] + np.cumsum(e.a_size[a])).tolist(), b, (row["b_start"] + np.cumsum(e.b_size[b])).tolist())
                record = _record(Fragment.of(tokens) if sound else Fragment(Tokens()), len(a), len(b), sound)
                yield pa.RecordBatch.from_pylist([{key: row[key], "_row": row["_row"], "_chunk": row["_chunk"], **record}], schema=arrow)

    def compose(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        records = group.sort_by("_chunk").to_pylist()
        merged = reduce(Fragment.__add__, map(_fragment, records))
        totals = sum(r["n_a"] for r in records), sum(r["n_b"] for r in records), all(r["sound"] for r in records)
        first = records[0]
        record = {key: first[key], "_row": first["_row"], "_chunk": first["_chunk"] // fan, **_record(merged, *totals)}
        return pa.Table.from_pylist([record], schema=to_arrow_schema(schema))

    cut = stage(rows.select(key, "_text", F.monotonically_increasing_id().alias("_row")).mapInArrow(split, parts), "ranges")
    most = cut.agg(F.max("_chunk")).first()[0]
    if most is None:
        return None
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = cut.repartition(n, "_row", "_chunk").mapInArrow(fragments, schema)
    while most:
        left = stage(left, "fragments")
        left = left.groupBy("_row", F.floor(F.col("_chunk") / fan)).applyInArrow(compose, schema)
        most //= fan
    return left


def _record(f: Fragment, n_a: int, n_b: int, sound: bool) -> dict:
    closed = ";".join(f.closed)
    return {"sound": sound, "n_a": n_a, "n_b": n_b, "cut": f.cut, "closed": closed, "links": f.links, "head": vars(f.head), "tail": vars(f.tail)}


def _fragment(record: dict) -> Fragment:
    closed = [record["closed"]] if record["closed"] else []
    return Fragment(Tokens(**record["head"]), record["cut"], closed, record["links"], Tokens(**record["tail"]))


def _finish(schema: T.StructType, key: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for record in batch.to_pylist():
                out = {n: v[0] for n, v in _nothing(1).items()} | {"n_links": 0}
                if record["sound"]:
                    text, n, links = _fragment(record).finish()
                    pairs, counts = np.unique(np.array(links, np.int64), return_counts=True)
                    out = {"n_a": record["n_a"], "n_b": record["n_b"], "n_groups": n, "n_links": len(links), "groups": text, "links": pairs.tolist(), "counts": counts.tolist()}
                yield pa.RecordBatch.from_pylist([{key: record[key], **out}], schema=arrow)

    return rows


def link_scores(aligned: DataFrame, broadcast_pairs: int = 2_000_000) -> DataFrame:
    """Per row of ``align_tokens``: _row, n_best, count_sum, from the counts of links over all rows.

    A link's count is how many links of all texts join the same two ids; it is a best one if no other link of its B id
    counts more.  Rows hold each different pair once, so a very frequent pair counts at most once a row in the shuffle.
    The counts are broadcast if there are at most ``broadcast_pairs`` (16 bytes each), else joined by pair, where
    adaptive execution splits a frequent one.  Rows without links are left out.
    """
    held = aligned.select("_row", F.explode(F.arrays_zip("links", "counts")).alias("_l")).select("_row", F.col("_l.links").alias("link"), F.col("_l.counts").alias("n"))
    totals = stage(held.groupBy("link").agg(F.sum("n").alias("total")), "link-counts")
    b_id = F.col("link").bitwiseAND((1 << _PAIR) - 1)
    best = totals.groupBy(b_id.alias("_b")).agg(F.max("total").alias("_most"))
    totals = stage(totals.join(best, b_id == F.col("_b")).select("link", "total", (F.col("total") == F.col("_most")).alias("best")), "link-best")
    if totals.count() <= broadcast_pairs:
        totals = F.broadcast(totals)
    return held.join(totals, "link").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum")
    )
