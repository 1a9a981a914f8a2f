"""Ordered-series plans that never put a whole series into one task.

``Window.partitionBy("ticker")`` is the obvious way to write a rolling feature,
but one ticker may hold a third of all rows.  Every window the operators use looks
back (or ahead) a *bounded number of rows*, so a series can be cut into blocks
as long as each block also receives the few neighbouring rows it looks at.
``block_series`` does exactly that:

1. count rows per key; a series of at most one block is its own block and needs no more;
2. count the rows of longer series per (key, time span) -- a map-side combined aggregate, tiny;
3. turn the counts into row offsets per key and so into block numbers;
4. join the counts back and send each row to its own block, plus, for rows of
   the spans next to a block border, to the neighbouring block;
5. windows run per (key, block) and only a block's own rows are kept.

A span with more rows than a block is cut into finer ones first.

The counts are stored, so step 4 is a broadcast join whenever they are small (Catalyst decides from
their real size) and a sort-merge join on (key, span) otherwise.  No more series than rows / block can
be long, so many short series bring no counts at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.functions.exprs import MICROS, as_ordinal, so_far
from causalbars.llm.bits import BitTable, bit_table
from causalbars.plans.staging import stage

DAY = 86_400


@dataclass(frozen=True)
class SeriesSpec:
    """How a table is read as a set of ordered series.

    ``span_seconds`` is the width of the counting spans; pick it so that a span
    holds some tens to some thousands of rows.  ``rows_per_block`` bounds the
    rows a task sorts for one block.
    """

    keys: tuple[str, ...] = ("ticker",)
    ts: str = "timestamp"
    span_seconds: int = 30 * DAY
    rows_per_block: int = 250_000

    def at(self, ts: str) -> "SeriesSpec":
        return SeriesSpec(self.keys, ts, self.span_seconds, self.rows_per_block)


DAILY = SeriesSpec()
INTRADAY = SeriesSpec(span_seconds=DAY)

_SPAN, _LO, _HI, _N = "_span", "_lo", "_hi", "_n"
_HOME, _BLOCK, _CORE, _WEIGHT = "_home", "_block", "_core", "_weight"
_PLACE = "_place"
_INTERNAL = (_SPAN, _LO, _HI, _N, _HOME, _BLOCK, _CORE, _WEIGHT, _PLACE, "_targets", "_long")


@dataclass(frozen=True)
class Rolling:
    """``avg`` or ``stddev_samp`` of a column over the rows ``first`` to ``last`` places back, null below ``min_count`` values."""

    name: str
    fn: str
    column: str | Column
    first: int
    last: int = 1
    min_count: int = 1


class BlockedSeries:
    """A table whose rows were distributed to (key, block) groups."""

    def __init__(self, df: DataFrame, spec: SeriesSpec, whole: bool = False):
        self.df = df
        self.spec = spec
        self.whole = whole
        # Where each series is one block, the block's number is a constant, which no plan partitions by.
        self.group = list(spec.keys) if whole else [*spec.keys, _BLOCK]

    def window(self, *ties: str | Column) -> WindowSpec:
        """Rows of one block in time order; ``ties`` break equal timestamps."""
        return Window.partitionBy(*self.group).orderBy(self.spec.ts, *ties)

    def window_desc(self, *ties: str | Column) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(F.desc(self.spec.ts), *ties)

    def position(self, *ties: str | Column) -> Column:
        """Zero-based position of a counted row within its whole series."""
        frame = so_far(self.window(*ties))
        if self.whole:
            return F.sum(_WEIGHT).over(frame) - 1
        return F.first(_LO).over(frame) + F.sum(_WEIGHT).over(frame) - 1

    def series_length(self) -> Column:
        """Number of counted rows in the whole series; a short series is one block, which counts its own."""
        return F.coalesce(F.col(_N), F.sum(_WEIGHT).over(Window.partitionBy(*self.group)))

    def in_order(self, *ties: str) -> "BlockedSeries":
        """The same rows, each block sorted by time in one task, as ``rolled`` reads them."""
        df = self.df.repartition(*self.group).sortWithinPartitions(*self.group, self.spec.ts, *ties)
        return BlockedSeries(df.withColumn(_PLACE, F.row_number().over(self.window(*ties))), self.spec, self.whole)

    def rolled(
        self,
        df: DataFrame,
        stats: Sequence[Rolling],
        at: DataFrame | None = None,
        only: Column | None = None,
        carried: Sequence[str] = (),
    ) -> DataFrame:
        """Add rolling statistics to ``df``, which adds columns to an ``in_order`` series.

        Spark's sliding frames visit a frame's rows one by one for each row.  Here a batch's rows take each place of the
        frame together, oldest first, with Spark's own updates, so results are the same to the last bit.  A task
        holds one batch and the rows that the widest frame looks back to.

        ``at`` (keys, time) names the rows that are asked for: most others are left out before they go anywhere.
        ``only`` tells the rows asked for exactly: the others give their values and end there, and of these rows come the columns ``carried``.
        """
        columns = {f"_in{i}": (F.col(s.column) if isinstance(s.column, str) else s.column).cast("double") for i, s in enumerate(stats)}
        given = df.drop(*_whole()) if self.whole else df
        kept = given.drop(_PLACE)
        if only is not None:
            names = [*carried, *([] if self.whole else [_LO, _N, _BLOCK, _CORE])]
            row = F.when(only, F.struct(*[F.col(f"`{c}`") for c in names])).alias("_row")
            given = df.select(_PLACE, row, *[c.alias(n) for n, c in columns.items()])
            columns, kept = {}, given.select("_row")
        frames = [(s.name, s.fn == "avg", s.first, s.last, s.min_count) for s in stats]
        added = [T.StructField(s.name, T.DoubleType()) for s in stats]
        wanted = None
        if at is not None:
            names = [*self.spec.keys, self.spec.ts]
            # Cast as a row's own columns are, so that a row that a join would find has its bit.
            wanted = bit_table(at.select(F.xxhash64(*[F.col(a).cast(df.schema[c].dataType) for a, c in zip(at.columns, names, strict=True)])))
            columns["_asked"] = F.xxhash64(*names)
        given = given.withColumns(columns) if columns else given
        out = given.mapInArrow(_roll(frames, kept.columns, wanted, only is not None), T.StructType([*kept.schema.fields, *added]))
        if only is not None:
            out = out.select("_row.*", *[s.name for s in stats])
        return out.withColumns(_whole()) if self.whole else out

    @staticmethod
    def own_rows() -> Column:
        """True for the rows a block is responsible for, false for its neighbours'."""
        return F.col(_CORE)


def _roll(frames: list[tuple[str, bool, int, int, int]], kept: list[str], wanted: BitTable | None, only: bool = False):
    """Rolling statistics of rows that come block by block in the order of time; ``_place`` counts a block's rows from 1.

    ``only`` leaves out rows whose ``_row`` is null, which gave their values and are not asked for.
    Everything that runs in a task stands inside, so it travels with the function.
    """
    depth = max(first for _, _, first, _, _ in frames)

    def statistic(x, known, place, is_avg: bool, first: int, last: int, least: int):
        """A statistic of the rows behind the first ``depth``, and where it has a value."""
        n = len(place)
        count, mean, total = np.zeros(n), np.zeros(n), np.zeros(n)
        for back in range(first, last - 1, -1):
            at = depth - back
            value, there = x[at : at + n], known[at : at + n] & (place > back)
            count += there
            if is_avg:
                total = np.where(there, total + value, total)
            else:
                delta = value - mean
                step = delta / count
                total = np.where(there, total + delta * (delta - step), total)
                mean = np.where(there, mean + step, mean)
        if is_avg:
            return total / count, count >= max(least, 1)
        return np.sqrt(total / (count - 1)), count >= max(least, 2)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [(np.zeros(depth), np.zeros(depth, bool)) for _ in frames]
        for batch in batches:
            n, place, out = batch.num_rows, batch.column("_place").to_numpy(), []
            for i, (_, *frame) in enumerate(frames):
                column = batch.column(f"_in{i}")
                x = np.concatenate([before[i][0], column.fill_null(0.0).to_numpy()])
                known = np.concatenate([before[i][1], column.is_valid().to_numpy(zero_copy_only=False)])
                before[i] = x[n:], known[n:]
                with np.errstate(all="ignore"):
                    value, valid = statistic(x, known, place, *frame)
                out.append(pa.array(value, mask=~valid))
            done = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out], [*kept, *[f[0] for f in frames]])
            if only:
                done = done.filter(batch.column("_row").is_valid())
            yield done if wanted is None else done.filter(pa.array(wanted.has(batch.column("_asked").to_numpy())))

    return roll


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*_INTERNAL)


def _whole() -> dict[str, Column]:
    """What placing adds to the rows where each series is one block."""
    zero = F.lit(0).cast("long")
    return {_LO: zero, _N: F.lit(None).cast("long"), _BLOCK: zero, _CORE: F.lit(True)}


def block_series(
    df: DataFrame,
    lookback: int,
    lookahead: int = 0,
    spec: SeriesSpec = DAILY,
    weight: Column | None = None,
) -> BlockedSeries:
    """Distribute ``df`` into blocks that see ``lookback`` / ``lookahead`` counted rows.

    ``weight`` (0 or 1) says which rows count; rows with weight 0 ride along
    and are never copied to a neighbouring block.
    """
    size = max(spec.rows_per_block, lookback + 1, lookahead + 1)
    keys = list(spec.keys)
    rows = df.withColumn(_WEIGHT, (F.lit(1) if weight is None else weight).cast("int"))
    for c in (*keys, spec.ts):
        rows = rows.where(F.col(c).isNotNull())
    long = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > size), "long-series")
    zero = F.lit(0).cast("long")
    if long.isEmpty():
        return BlockedSeries(rows.withColumns(_whole()), spec, True)
    rows = rows.join(long.select(*keys, F.lit(True).alias("_long")), keys, "left")
    rows, counts = _counted_spans(rows, spec, as_ordinal(F.col(spec.ts), df.schema[spec.ts].dataType), size)

    by_key = Window.partitionBy(*keys)
    in_order = by_key.orderBy(_SPAN)
    spans = (
        counts.withColumn(_HI, F.sum("_cnt").over(so_far(in_order)))
        .withColumn(_LO, F.col(_HI) - F.col("_cnt"))
        .withColumn(_N, F.sum("_cnt").over(by_key))
        .withColumn(_HOME, F.floor(F.col(_LO) / size))
    )
    targets = [F.array(F.col(_HOME))]
    if lookback:
        # later blocks whose rows look back into this span
        targets.append(F.sequence(F.floor(F.col(_HI) / size), F.floor((F.col(_HI) + (lookback - 1)) / size)))
    if lookahead:
        # earlier blocks whose rows look ahead into this span
        spans = spans.withColumn("_prev", F.lag(_HOME).over(in_order))
        targets.append(F.collect_set("_prev").over(by_key.orderBy(_LO).rangeBetween(-lookahead, 0)))
    spans = spans.withColumn("_targets", F.array_distinct(F.concat(*targets))).select(
        *keys, _SPAN, _LO, _N, _HOME, "_targets"
    )

    home = F.coalesce(_HOME, zero)
    placed = (
        rows.join(spans, [*keys, _SPAN], "left")
        .withColumn(_BLOCK, F.explode(F.when(F.col(_WEIGHT) > 0, F.coalesce("_targets", F.array(home))).otherwise(F.array(home))))
        .withColumns({_CORE: F.col(_BLOCK) == home, _LO: F.coalesce(_LO, zero)})
        .drop("_targets")
    )
    return BlockedSeries(placed, spec)


_PIECES = 1024  # finer spans in a dense one, each step


def _counted_spans(rows: DataFrame, spec: SeriesSpec, at: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their counting span ``_span``, and the stored counts ``_cnt`` of rows that count in each (keys, span) of a long series.

    A span that holds more than ``size`` rows is dense: each pass cuts those that are left into 1,024 pieces of time, down to single
    microseconds (five passes from 30 days).  Rows of one key and one microsecond stay together.
    """
    keys, width = list(spec.keys), spec.span_seconds * MICROS

    def counts(of: DataFrame, *span: str) -> DataFrame:
        found = of.where("_long").groupBy(*keys, *span).agg(F.sum(_WEIGHT).alias("_cnt"), F.count(F.lit(1)).alias("_rows"))
        return stage(found, "span-counts")

    rows = rows.withColumn(_SPAN, F.floor(at / width))
    found, step, names = counts(rows, _SPAN), width, [_SPAN]
    dense = found.where(F.col("_rows") > size)
    if dense.isEmpty():
        return rows, found.drop("_rows")
    rows = rows.withColumnRenamed(_SPAN, "_whole").withColumn("_fine", F.lit(0).cast("long"))
    found = found.withColumnRenamed(_SPAN, "_whole").withColumn("_fine", F.lit(0).cast("long"))
    names = ["_whole", "_fine"]
    while step > 1 and not (dense := found.where(F.col("_rows") > size)).isEmpty():
        step = -(-step // _PIECES)
        marks = dense.select(*keys, *names, F.lit(True).alias("_dense"))
        fine = F.floor((at - F.col("_whole") * width) / step) * step + 1
        rows = rows.join(marks, [*keys, *names], "left")
        rows = rows.withColumn("_fine", F.when(F.col("_dense"), fine).otherwise(F.col("_fine"))).drop("_dense")
        found = counts(rows, *names)
    span = F.struct(*names)
    return rows.withColumn(_SPAN, span).drop(*names), found.withColumn(_SPAN, span).drop("_rows", *names)


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``<value>_cum``: the running total of each value in ``order``, ties excluded.

    ``df`` holds one row per (keys, order).  Totals are taken per bucket first,
    accumulated over the (few) buckets, and added to the running total inside each
    bucket, so no task sees more than one bucket.  The default bucket is one day
    of a timestamp column.
    """
    if bucket is None:
        bucket = F.floor(as_ordinal(F.col(order), df.schema[order].dataType) / (DAY * MICROS))
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    over_buckets = so_far(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket"))
    offsets = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    offsets = offsets.select(
        *keys,
        "_bucket",
        *[(F.sum(f"_sum_{v}").over(over_buckets) - F.col(f"_sum_{v}")).alias(f"_off_{v}") for v in values],
    )
    in_bucket = so_far(Window.partitionBy(*keys, "_bucket").orderBy(order))
    out = rows.join(offsets, [*keys, "_bucket"])
    for v in values:
        out = out.withColumn(f"{v}_cum", F.col(f"_off_{v}") + F.sum(v).over(in_bucket))
    return out.drop("_bucket", *[f"_off_{v}" for v in values])


_PART, _AT = "_part", "_at"


def ordered_parts(df: DataFrame, order: Sequence[str], name: str = "ordered") -> DataFrame:
    """``df`` sorted by ``order`` (nulls first) into parts of about equal size, written once.

    A range partitioning makes the parts.  Rows equal in ``order`` are dealt to several of them by a running id, so a hot value is
    split.  Adds the part's number ``_part`` and ``_at``, which grows with the order and counts the rows of a part from 0 in
    its lower 33 bits.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn(_AT, F.monotonically_increasing_id())
    )
    return stage(ranked, name).withColumn(_PART, F.shiftright(_AT, 33))


def running_in_parts(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str], maxima: Sequence[str] = (), backward: bool = False
) -> DataFrame:
    """Add ``<column>_run``: the sum or maximum of a column over the rows of the same keys up to a row, in the order of the parts.

    ``df`` comes from ``ordered_parts`` with an order that begins with ``keys``.  Rows are accumulated within (keys, part), and what the parts
    before hold is one row for each part and key, so no group is larger than a part, however many rows a key
    has.  Backward, it is the rows from a row to the end.
    """
    keys = list(keys)
    within, over = Window.partitionBy(*keys, _PART), Window.partitionBy(*keys)
    within = within.orderBy(F.desc(_AT)) if backward else within.orderBy(_AT)
    over = over.orderBy(F.desc(_PART)) if backward else over.orderBy(_PART)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    each = [(c, F.sum) for c in sums] + [(c, F.max) for c in maxima]
    parts = df.groupBy(*keys, _PART).agg(*[f(c).alias(f"_all_{c}") for c, f in each])
    parts = parts.select(*keys, _PART, *[f(f"_all_{c}").over(before).alias(f"_before_{c}") for c, f in each])
    same = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in (*keys, _PART)]
    held = df.join(parts.withColumnsRenamed({k: f"_p_{k}" for k in (*keys, _PART)}), same)
    for c, f in each:
        here, earlier = f(c).over(so_far(within)), F.col(f"_before_{c}")
        total = F.coalesce(here + earlier, here, earlier) if f is F.sum else F.greatest(here, earlier)
        held = held.withColumn(f"{c}_run", total)
    return held.drop(*[f"_before_{c}" for c, _ in each], *[f"_p_{k}" for k in (*keys, _PART)])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with gapless global row numbers from 0 in the order of ``order`` (nulls first).

    A row's number is its index in its part plus the rows of the parts before, which is one number
    per part.  Which of two equal rows comes first is immaterial.  The sorted rows are written once,
    so counts and numbers come from the same rows even after the loss of an executor.
    """
    ranked = ordered_parts(df, order, "numbered")
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(_PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    index = F.col(_AT).bitwiseAND((1 << 33) - 1)
    # One row per part of the range partitioning, so its size is set by a parameter.
    return (
        ranked.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_before") + index)
        .drop(_PART, _AT, "_before")
    )


def global_position(df: DataFrame, ts: str, ties: Sequence[str], name: str = "pos") -> DataFrame:
    """Zero-based position of every row in the total order ``(ts, *ties)``; no group is a timestamp, however many rows it has."""
    return numbered(df, [ts, *ties], name)


def asof_join(
    probes: DataFrame,
    rows: DataFrame,
    value: Column,
    name: str,
    probe_ts: str,
    rows_ts: str = "timestamp",
    direction: str = "backward",
    spec: SeriesSpec = DAILY,
    strict: bool = False,
) -> DataFrame:
    """Attach to each probe the value of the nearest row at or before / after its time.

    Both bounds are inclusive unless ``strict``.  An as-of match looks at one
    counted row, so it is a blocked series with a lookback (or lookahead) of one.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    keys = list(spec.keys)
    series = spec.at("_ts")
    right = rows.select(
        *keys, F.col(rows_ts).alias("_ts"), F.struct(value.alias("v")).alias("_hit"), F.lit(1).alias("_is_row")
    )
    left = probes.select(
        *keys, F.col(probe_ts).alias("_ts"), F.struct(*probes.columns).alias("_probe"), F.lit(0).alias("_is_row")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    backward = direction == "backward"
    blocks = block_series(both, int(backward), int(not backward), series, weight=F.col("_is_row"))
    rows_first = F.asc("_is_row") if strict else F.desc("_is_row")
    w = blocks.window(rows_first) if backward else blocks.window_desc(rows_first)
    hit = F.last("_hit", ignorenulls=True).over(so_far(w))
    return (
        blocks.df.withColumn("_match", hit)
        .where((F.col("_is_row") == 0) & blocks.own_rows())
        .select("_probe.*", F.col("_match.v").alias(name))
    )
