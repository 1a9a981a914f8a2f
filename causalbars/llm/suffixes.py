"""Exact removal of repeated byte strings: sampled suffixes, sorted by hash comparison."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.llm.bits import bit_table, bits_for, mix64
from causalbars.plans.staging import stage

_BASE = 0x9E3779B97F4A7C15
_CHUNK = 2_000_000
_CORES = 24  # bytes of the sampled substring
_BLOCK = 1 << 15  # windows that are sampled at a time
_WINDOWS = 400_000
_HOT = 20_000  # contexts of one sample from which on its windows are dealt out one by one
_SLICE = 4_000  # contexts that are split at a time
_HELD = 40_000  # rows that a task holds at a time
_SETTLED = 8_000  # of these, rows that are settled at a time, in whole groups

u64 = np.uint64


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, _CHUNK + 4096)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, u64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=u64))
    return _POWERS[0], _POWERS[1]


class PrefixHashes:
    """Polynomial hashes of all prefixes of a buffer: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, u64)
        np.cumsum((data.astype(u64) + u64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length, up to ``most``, of the longest common extension of suffixes a and b, by binary search."""
        out = np.where(self.of(a, most) == self.of(b, most), most, 0)
        open_ = np.flatnonzero(out == 0)
        a, b = a[open_], b[open_]
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), most - 1)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[open_] = low
        return out

    def after(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1: order of the suffixes by their first ``most`` bytes."""
        n = self.common(a, b, most)
        end = len(self.data) - 1
        step = self.data[np.minimum(a + n, end)].astype(np.int16) - self.data[np.minimum(b + n, end)]
        return np.where(n >= most, 0, np.sign(step))


def suffix_merge_sort(hashes: PrefixHashes, suffixes: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of ``suffixes`` inside each run of equal ``group`` by their first ``most`` bytes; equal ones keep their order.

    A bottom-up mergesort of all groups at once: at each level every suffix looks up its rank in the neighbouring run by
    binary search, each comparison being a common extension found with prefix hashes.
    """
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    start, length = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(len(group))
    width = 1
    while len(size) and width < size.max():
        at = np.flatnonzero(length > width)
        inside = at - start[at]
        run = inside // width
        other = (run ^ 1) * width
        low = np.zeros(len(at), np.int64)
        high = np.clip(length[at] - other, 0, width)
        # A suffix of a left run goes behind smaller ones of the right run, one of a right run also behind equal ones.
        limit = (run & 1).astype(np.int64)
        mine = suffixes[order[at]]
        busy = np.flatnonzero(low < high)
        while len(busy):
            mid = (low[busy] + high[busy]) >> 1
            theirs = suffixes[order[start[at[busy]] + other[busy] + mid]]
            before = hashes.after(theirs, mine[busy], most) < limit[busy]
            low[busy] = np.where(before, mid + 1, low[busy])
            high[busy] = np.where(before, high[busy], mid)
            busy = busy[low[busy] < high[busy]]
        new = order.copy()
        new[start[at] + (run >> 1) * 2 * width + (inside - run * width) + low] = order[at]
        order = new
        width *= 2
    return order


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings really are equal."""
    if not len(a):
        return np.zeros(0, bool)
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 50_000):
        hi = min(lo + 50_000, len(a))
        n = length[lo:hi]
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        same = data[np.repeat(a[lo:hi], n) + step] == data[np.repeat(b[lo:hi], n) + step]
        out[lo:hi] = np.logical_and.reduceat(same, ends - n)
    return out


@dataclass
class Anchors:
    """Sampled suffixes of a buffer: windows start + lo .. start + hi share the sample at start."""

    core: np.ndarray
    start: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def anchors(hashes: PrefixHashes, starts: np.ndarray, lengths: np.ndarray, window: int) -> Anchors:
    """For every window of the segments its substring of least hash (the leftmost of equal ones), as runs of windows.

    Equal windows have the same sample at the same offset, so only windows with equal samples need to be compared.
    Hashes are taken in blocks that stay in a core's cache; their lowest bits (16 for 100 bytes) give way to the place in the block.
    """
    n, width = len(hashes.data), window - _CORES + 1
    empty = np.zeros(0, np.int64)
    long = lengths >= window
    if not long.any():
        return Anchors(np.zeros(0, u64), empty, empty, empty)
    first, sample, core = [], [], []
    low = u64((1 << (_BLOCK + width).bit_length()) - 1)
    for lo in range(0, n - window + 1, _BLOCK):
        hi = min(lo + _BLOCK, n - window + 1) + width - 1
        value = mix64((hashes.sums[lo + _CORES : hi + _CORES] - hashes.sums[lo:hi]) * hashes.down[lo:hi])
        least, span = (value & ~low) | np.arange(hi - lo, dtype=u64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (least[new] & low).astype(np.int64)
        first.append(new + lo), sample.append(place + lo), core.append(value[place])
    first, sample, core = np.concatenate(first), np.concatenate(sample), np.concatenate(core)
    # A run goes on over the border of a block and ends with its segment.
    fresh = np.r_[True, sample[1:] != sample[:-1]]
    first, sample, core = first[fresh], sample[fresh], core[fresh]
    begin, end = starts[long], (starts + lengths - window + 1)[long]
    at = np.sort(np.concatenate([first, begin, end]), kind="stable")
    at = at[np.r_[True, at[1:] != at[:-1]]]
    segment = np.searchsorted(begin, at, side="right") - 1
    inside = np.flatnonzero((segment >= 0) & (at < end[segment]))
    run = np.searchsorted(first, at[inside], side="right") - 1
    until = np.r_[at[1:], n][inside] - 1
    start = sample[run]
    return Anchors(core[run], start, at[inside] - start, until - start)


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """Chunks of about ``_CHUNK`` bytes: buffer, (doc, row, offset) per segment, starts, lengths.

    A long text is cut into segments that overlap by window - 1 bytes, so each window is in exactly one.
    """
    parts, names, size = [], [], 0

    def done():
        lengths = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), list(names), np.cumsum(lengths) - lengths, lengths

    for batch in batches:
        for doc, row, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(len(raw) - window + 1, 0), _CHUNK):
                piece = raw[at : at + _CHUNK + window - 1]
                parts.append(piece)
                names.append((doc, row, at))
                size += len(piece)
                if size >= _CHUNK:
                    yield done()
                    parts.clear(), names.clear()
                    size = 0
    if parts:
        yield done()


def _cores(window: int):
    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, _, starts, lengths in _segments(batches, window):
            hashes = PrefixHashes(data)
            a = anchors(hashes, starts, lengths, window)
            found, times = np.unique(a.core, return_counts=True)
            # Different contexts are what the next pass sends; one more for equal ones, so that a sample met twice is above 1.
            _, first = np.unique(_context_hash(hashes, a.core, a.start, a.lo, a.hi, window), return_index=True)
            kinds = np.unique(a.core[first], return_counts=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(kinds + (times > kinds))], ["core", "times"])

    return cores


_ROWS = "core bigint, doc bigint, row bigint, start bigint, lo int, hi int, context binary"


def _contexts(window: int, bits):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, names, starts, lengths in _segments(batches, window):
            hashes = PrefixHashes(data)
            found = anchors(hashes, starts, lengths, window)
            some = np.flatnonzero(bits.has(found.core.view(np.int64)))
            core, start, lo, hi = found.core[some], found.start[some], found.lo[some], found.hi[some]
            segment = np.searchsorted(starts, start, side="right") - 1
            docs, rows, offsets = (np.array([n[i] for n in names], np.int64)[segment] for i in range(3))
            place = start - starts[segment] + offsets
            order = np.lexsort((place, rows, docs))
            core, start, lo, hi, docs, rows, place = (x[order] for x in (core, start, lo, hi, docs, rows, place))
            repeat = _repeated_contexts(hashes, core, start, lo, hi, docs, rows, place, window)
            # A context that an earlier one in this chunk equals is settled here: its windows are all repeats.
            keep = np.flatnonzero(repeat == 0)
            raw = data.tobytes()
            context = [raw[a:b] for a, b in zip((start + lo)[keep].tolist(), (start + hi + window)[keep].tolist(), strict=True)]
            yield _batch(core[keep], docs[keep], rows[keep], place[keep], lo[keep], hi[keep], context)
            gone = np.flatnonzero(repeat == 1)
            yield _batch(mix64(rows[gone].view(u64)), docs[gone], rows[gone], place[gone], lo[gone], hi[gone], [None] * len(gone))

    return contexts


def _batch(core, doc, row, start, lo, hi, context) -> pa.RecordBatch:
    columns = [pa.array(core.view(np.int64)), pa.array(doc), pa.array(row), pa.array(start), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(context, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["core", "doc", "row", "start", "lo", "hi", "context"])


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and where each value begins, with the end."""
    parts = [(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64), c) for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = [np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] for at, c in parts]
    lengths = np.concatenate([np.diff(at) for at, _ in parts])
    return data[0] if len(data) == 1 else np.concatenate(data), np.r_[0, np.cumsum(lengths)]


def _window_hashes(table: pa.Table, window: int):
    """Of rows with a context: the bytes, their prefix hashes, and per window its row, its distance from the core, its place in the bytes and its hash."""
    data, offset = _bytes_of(table.column("context"))
    raw, lengths = data.tobytes(), np.diff(offset)
    hashes = PrefixHashes(data)
    n = lengths - window + 1
    member = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(lengths) - lengths)[member] + step
    return raw, hashes, member, step + table.column("lo").to_numpy()[member], at, mix64(hashes.of(at, window))


def _hot_rows(batch: pa.RecordBatch, hot) -> tuple[np.ndarray, Iterator[pa.Table]]:
    """Which rows carry the context of a hot sample, and these in slices."""
    table = pa.Table.from_batches([batch])
    own = hot.has(batch.column("core").to_numpy()) & batch.column("context").is_valid().to_numpy(zero_copy_only=False)
    rows = table.filter(pa.array(own))
    return own, (rows.slice(i, _SLICE) for i in range(0, rows.num_rows, _SLICE))


def _hot_windows(window: int, hot):
    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _hot_rows(batch, hot)[1]:
                found, times = np.unique(_window_hashes(rows, window)[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2))], ["core", "times"])

    return hot_windows


def _split(window: int, hot, again):
    """Contexts of hot samples as single windows under their own hash, those met once left out; the other rows as they are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, slices = _hot_rows(batch, hot)
            yield batch.filter(pa.array(~own))
            for rows in slices:
                raw, hashes, member, shift, at, key = _window_hashes(rows, window)
                some = np.flatnonzero(again.has(key.view(np.int64)))
                member, shift, at, key = member[some], shift[some], at[some], key[some]
                doc, row, start = (rows.column(c).to_numpy()[member] for c in ("doc", "row", "start"))
                place = start + shift
                order = np.lexsort((place, row, doc))
                doc, row, place, at, key = doc[order], row[order], place[order], at[order], key[order]
                zero = np.zeros(len(order), np.int64)
                repeat = _repeated_contexts(hashes, key, at, zero, zero, doc, row, place, window)
                keep = np.flatnonzero(repeat == 0)
                yield _batch(key[keep], doc[keep], row[keep], place[keep], zero[keep], zero[keep], [raw[i : i + window] for i in at[keep].tolist()])
                gone = np.flatnonzero(repeat == 1)
                doc, row, place = doc[gone], row[gone], place[gone]
                fresh = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)][: len(gone)])
                size = np.diff(np.r_[fresh, len(gone)])
                yield _batch(mix64(row[fresh].view(u64)), doc[fresh], row[fresh], place[fresh], zero[: len(fresh)], size - 1, [None] * len(fresh))

    return split


def _context_hash(hashes: PrefixHashes, core, start, lo, hi, window: int) -> np.ndarray:
    length = hi - lo + window
    return mix64(hashes.of(start + lo, length) + mix64(core + (length * 256 - lo).astype(u64)))


def _repeated_contexts(hashes: PrefixHashes, core, start, lo, hi, doc, row, place, window: int) -> np.ndarray:
    """Per anchor, in order of place: 0 first of its context, 1 equal to an earlier one (byte by byte), 2 the same row again."""
    length = hi - lo + window
    whole = _context_hash(hashes, core, start, lo, hi, window)
    order = np.argsort(whole, kind="stable")
    new = np.r_[True, whole[order][1:] != whole[order][:-1]] if len(order) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    out = np.zeros(len(order), np.int8)
    rest = np.flatnonzero(~new)
    a, b = order[rest], head[rest]
    alike = (lo[a] == lo[b]) & (hi[a] == hi[b]) & (core[a] == core[b])
    same = np.zeros(len(a), bool)
    same[alike] = _equal_bytes(hashes.data, (start + lo)[a[alike]], (start + lo)[b[alike]], length[a[alike]])
    previous = order[rest - 1]
    again = (doc[a] == doc[previous]) & (row[a] == row[previous]) & (place[a] == place[previous])
    out[a[same]] = 1
    # A row that is in the table more than once is one document.
    firsts = (doc[a] == doc[b]) & (row[a] == row[b]) & (place[a] == place[b])
    out[a[(again | firsts) & same]] = 2
    return out


def _perhaps_twice(hashes: np.ndarray) -> np.ndarray:
    """True for all hashes that are there more than once, and for few others."""
    bits = max(len(hashes), 1).bit_length() + 2
    at = (hashes >> u64(64 - bits)).astype(np.int64)
    return np.bincount(at, minlength=1 << bits)[at] > 1


def _settle(rows: dict[str, np.ndarray], data: np.ndarray, offset: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of whole core groups, as (member, first window, last window) runs.

    Rows come by core, then place.  Equal contexts are settled as wholes; in groups with several contexts every window of
    each context is a suffix, sorted with those at the same distance from the same core.
    """
    core, lo, hi = rows["core"], rows["lo"].astype(np.int64), rows["hi"].astype(np.int64)
    hashes = PrefixHashes(data)
    anchor = offset - lo  # where the core stands in the buffer
    state = _repeated_contexts(hashes, core, anchor, lo, hi, rows["doc"], rows["row"], rows["start"], window)
    whole = np.flatnonzero(state == 1)
    members, firsts, lasts = [whole], [lo[whole]], [hi[whole]]
    left = np.flatnonzero(state == 0)
    group = core[left]
    border = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(left) else np.zeros(0, np.int64)
    size = np.diff(np.r_[border, len(left)])
    left = left[np.repeat(size > 1, size)]
    if len(left):
        width = max(1, min(window, _WINDOWS // len(left)))
        for r in range(int(lo[left].min()), int(hi[left].max()) + 1, width):
            a, b = np.maximum(lo[left], r), np.minimum(hi[left], r + width - 1)
            some = left[a <= b]
            n = (b - a + 1)[a <= b]
            member = np.repeat(some, n)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[a <= b], n)
            key = mix64(core[member] + (shift + window).astype(u64) * u64(_BASE))
            # Most windows have no equal: their hashes tell, before anything is sorted.
            twice = np.flatnonzero(_perhaps_twice(mix64(key ^ hashes.of(anchor[member] + shift, window))))
            if len(twice) < 2:
                continue
            member, shift, key = member[twice], shift[twice], key[twice]
            order = np.lexsort((member, shift, core[member]))
            member, shift, key = member[order], shift[order], key[order]
            alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
            member, shift, key = member[~alone], shift[~alone], key[~alone]
            suffix = anchor[member] + shift
            order = suffix_merge_sort(hashes, suffix, key, window)
            member, shift, key, suffix = member[order], shift[order], key[order], suffix[order]
            if len(suffix) < 2:
                continue
            near = np.flatnonzero(key[1:] == key[:-1]) + 1
            near = near[hashes.common(suffix[near - 1], suffix[near], window) >= window]
            near = near[_equal_bytes(data, suffix[near - 1], suffix[near], np.full(len(near), window))]
            members.append(member[near]), firsts.append(shift[near]), lasts.append(shift[near])
    return np.concatenate(members), np.concatenate(firsts), np.concatenate(lasts)


def _resolve(window: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= _HELD:
                table = pa.Table.from_batches(held)
                core = table.column("core").to_numpy()
                cut = int(np.searchsorted(core, core[-1], side="left"))
                if cut:
                    yield from runs(table.slice(0, cut))
                    table = table.slice(cut)
                else:  # one key: of equal contexts the first stays to be compared with, of a single window that is one row
                    settled, table = firsts(table)
                    yield settled
                held, count = table.to_batches(), table.num_rows
        if held:
            yield from runs(pa.Table.from_batches(held))

    def firsts(table: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        known = table.column("context").is_null().to_numpy()
        rows, data, offset = unpacked(table.filter(pa.array(~known)))
        state = np.ones(table.num_rows, np.int8)
        state[~known] = _repeated_contexts(
            PrefixHashes(data), rows["core"], offset - rows["lo"], rows["lo"].astype(np.int64), rows["hi"].astype(np.int64), rows["doc"], rows["row"], rows["start"], window
        )
        gone = np.flatnonzero(state == 1)
        lo, hi = (table.column(c).to_numpy().astype(np.int64)[gone] for c in ("lo", "hi"))
        return spans(table, gone, lo, hi), table.filter(pa.array(state == 0))

    def unpacked(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        rows = {c: table.column(c).to_numpy() for c in ("core", "doc", "row", "start", "lo", "hi")}
        rows["core"] = rows["core"].view(u64)
        data, offset = _bytes_of(table.column("context"))
        return rows, data, offset[:-1]

    def runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        settled = table.filter(pa.compute.is_null(table.column("context")))
        yield spans(settled, np.arange(settled.num_rows), settled.column("lo").to_numpy(), settled.column("hi").to_numpy())
        table = table.filter(pa.compute.is_valid(table.column("context")))
        core = table.column("core").to_numpy()
        ends = np.flatnonzero(np.r_[core[1:] != core[:-1], True][: len(core)]) + 1
        at, found = 0, []
        while at < len(core):
            until = int(ends[min(np.searchsorted(ends, at + _SETTLED), len(ends) - 1)])
            member, first, last = _settle(*unpacked(table.slice(at, until - at)), window)
            found.append((member + at, first, last))
            at = until
        if found:
            yield spans(table, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def spans(table: pa.Table, member: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        doc, row, start = (table.column(c).to_numpy()[member] for c in ("doc", "row", "start"))
        a, b = start + first, start + last + window
        order = np.lexsort((a, row, doc))
        doc, row, a, b = doc[order], row[order], a[order], b[order]
        if len(a):  # overlapping or touching spans of one document become one
            fresh = np.r_[True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]
            part = np.cumsum(fresh)
            reach = np.maximum.accumulate(b + part * (1 << 44)) - part * (1 << 44)
            first_of = np.r_[True, fresh[1:] | (a[1:] > reach[:-1])]
            at = np.flatnonzero(first_of)
            doc, row, a, b = doc[at], row[at], a[at], np.maximum.reduceat(b, at)
        columns = [pa.array(x) for x in (doc, row, a, b)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "row", "a", "b"])

    return resolve


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 100) -> DataFrame:
    """(row, doc, spans): byte ranges [a, b) of each document covered by a repeated string of ``window`` bytes.

    ``row`` is a hash of key and text.  A window repeats if its bytes start earlier: in a row of smaller (key, row), or earlier
    in the same text; null keys come last; equal rows are one document.

    1. Every window is represented by one sampled substring, the one of least hash, which equal windows share; some
       35 bytes have one sample.  Samples are counted over the whole corpus, each task sending each once.
    2. The texts are read again.  Samples that occur once are dropped, by a test of 8 to 64 MB (``bit_table``), eight bits for a sample
       that occurs again, that only lets too many through.  The others carry their context, the bytes of all their windows; contexts met
       again within a task are settled there and not sent.
    3. A sample with more than ``_HOT`` contexts, such as a common line with ever other surroundings, is not met in one
       task: its windows go under their own hashes, which equal windows share.  They are counted first and those met once are
       dropped; equal ones are settled within a task as before.
    4. Per sample, equal contexts are settled as wholes, and of different ones all windows are sorted as suffixes by a
       mergesort that compares with prefix hashes and binary search; neighbours that agree on ``window`` bytes are
       compared byte by byte before the later one counts as repeated.
    """
    source = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    counted = source.mapInArrow(_cores(window), "core bigint, times bigint").groupBy("core").agg(F.sum("times").alias("times"))
    several = stage(counted.where("times > 1"), "cores")
    found = source.mapInArrow(_contexts(window, bit_table(several.select("core"), bits_for(several.count()))), _ROWS)
    many = several.where(F.col("times") > _HOT).select("core")
    if not many.isEmpty():
        hot = bit_table(many)
        found = stage(found, "contexts")
        met = found.mapInArrow(_hot_windows(window, hot), "core bigint, times bigint").groupBy("core").agg(F.sum("times").alias("times"))
        found = found.mapInArrow(_split(window, hot, bit_table(met.where("times > 1").select("core"))), _ROWS)
    spread = found.repartition("core").sortWithinPartitions("core", "doc", "row", "start")
    spans = spread.mapInArrow(_resolve(window), "doc bigint, row bigint, a bigint, b bigint")
    grouped = spans.groupBy("row", "doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return stage(grouped, "spans")


def cut_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that are left."""
    kind = docs.schema[key].dataType.simpleString()
    row = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    source = docs.select(F.col(f"`{key}`").alias("_key"), row.alias("row"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("raw"))
    touched = bit_table(spans.select("row")).test()
    whole = source.where(~touched(F.col("row"))).select(
        F.col("_key").alias(key), F.octet_length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("raw").alias("kept")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in spans or ():
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                ends = [0] + [b for _, b in merged]
                kept = b"".join(raw[x:y] for x, y in zip(ends, [a for a, _ in merged] + [len(raw)], strict=True))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(merged), kept), strict=True):
                    column.append(value)
            columns = [batch.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_removed", "n_spans", "kept"])

    joined = source.where(touched(F.col("row"))).join(spans.select("row", "spans"), "row", "left").select("_key", "raw", "spans")
    return joined.mapInArrow(cut, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").unionByName(whole)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 100) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts earlier; see ``repeated_spans``.

    Strings are judged on the input, matches never cross documents, and cuts may fall inside a character, so ``kept`` is binary.
    A null or short text is left alone; equal rows are one document, each returned alike; an empty table
    has no result; other input columns are ignored.
    """
    return cut_spans(docs, repeated_spans(docs, key, text, window), key, text)
