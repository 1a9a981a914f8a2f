"""Triple-barrier labels, overlap weights and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.operators.features import MOMENTUM_WINDOWS, VOL_WINDOW, parts_of, price_rolls, price_steps, with_price_features
from causalbars.plans.series import DAILY, Rolling, SeriesSpec, block_series, drop_internal, running_totals
from causalbars.plans.staging import stage

# Volatility floor, weight of time-outs, minimum events per ticker.
VOL_FLOOR = 1e-4
VERTICAL_WEIGHT = 0.5
MIN_EVENTS = 10

LABEL_COLUMNS = ("t0", "t1", "label", "return_at_touch", "barrier_type", "sigma_t0", "raw_weight")


def _candidate(max_holding: int, vol_window: int, spacing: int, min_events: int) -> Column:
    """Every ``spacing``-th row after the warm-up that still has a full holding period ahead."""
    pos, n = F.col("_pos"), F.col("_length")
    safe_end = F.greatest(n - max_holding - 1, F.lit(vol_window))
    return (
        (n >= min_events + vol_window)
        & (pos >= vol_window)
        & (pos < safe_end)
        & ((pos - vol_window) % spacing == 0)
    )


def label_candidates(
    bars: DataFrame,
    max_holding: int = 20,
    vol_window: int = VOL_WINDOW,
    spacing: int = 1,
    min_events: int = MIN_EVENTS,
    spec: SeriesSpec = DAILY,
) -> DataFrame:
    """Entry candidates: the bars at which an event may start."""
    blocks = block_series(bars, 0, spec=spec)
    df = blocks.df.withColumns({"_pos": blocks.position(), "_length": blocks.series_length()})
    keep = _candidate(max_holding, vol_window, spacing, min_events)
    return drop_internal(df.where(blocks.own_rows() & keep).drop("_length").withColumnRenamed("_pos", "bar_no"))


BRANCH = 16  # price bars, or segments, in a segment of the next level


def _first_touch(placed: DataFrame, events: DataFrame, keys: list[str], max_holding: int) -> DataFrame:
    """Attach to each event ``_hit`` (level, seg, ts, px), the first bar behind it beyond one of its barriers, and ``_last``.

    ``placed`` holds the bars (keys, _pos, _ts, _px).  An event at ``_pos`` looks at the bars up to ``_limit``, where ``_last`` (ts, px) stands.
    A table of lowest and highest prices of aligned segments of 16, 256, ... bars says whether a segment can hold a
    touch.  The event's bars are covered by few segments, small ones first; the first that holds a
    touch is opened level by level.  An event thus asks for some 30 rows a level, whatever ``max_holding`` is.
    """
    px, at = F.col("_px"), F.struct(F.col("_ts").alias("ts"), F.col("_px").alias("px"))
    top = 0
    while BRANCH ** (top + 1) <= max_holding:
        top += 1
    table = placed.select(*keys, F.lit(0).alias("_level"), F.col("_pos").alias("_seg"), px.alias("_low"), px.alias("_high"), at.alias("_bar"))
    below = table
    for level in range(1, top + 1):
        seg = F.floor(F.col("_seg") / BRANCH).alias("_seg")
        below = stage(below.groupBy(*keys, seg).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")), "price-segments")
        table = table.unionByName(below.withColumn("_level", F.lit(level)), allowMissingColumns=True)

    first, limit, covers = F.col("_pos") + 1, F.col("_limit"), []
    for level in range(top + 1):
        last = F.floor(limit / BRANCH**level)
        end = last if level == top else F.least(F.ceil(first / BRANCH) * BRANCH - 1, last)
        segs = F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))
        covers.append(_segments(segs, level, False))
        first = F.ceil(first / BRANCH)
    covers.append(_segments(F.array(limit), 0, True))

    event = [*keys, "_pos", "_up", "_down"]
    touches = (F.col("_high") >= F.col("_up")) | (F.col("_low") <= F.col("_down"))
    found = F.struct("_level", "_seg", F.col("_bar.ts").alias("ts"), F.col("_bar.px").alias("px"))
    asked = events.select(*event, F.inline(F.flatten(F.array(*covers))))
    met = asked.join(table, [*keys, "_level", "_seg"])
    hits = met.groupBy(*event).agg(
        F.min(F.when(touches & ~F.col("_is_last"), found)).alias("_hit"), F.max(F.when(F.col("_is_last"), F.col("_bar"))).alias("_last")
    )
    for level in range(top, 0, -1):
        hits = stage(hits, "touches")
        opened = F.col("_hit._level") == level
        inner = F.explode(F.sequence(F.col("_hit._seg") * BRANCH, F.col("_hit._seg") * BRANCH + BRANCH - 1)).alias("_seg")
        asked = hits.where(opened).select(*event, "_last", F.lit(level - 1).alias("_level"), inner)
        met = asked.join(table, [*keys, "_level", "_seg"]).where(touches)
        deeper = met.groupBy(*event).agg(F.min(found).alias("_hit"), F.first("_last").alias("_last"))
        hits = hits.where(~F.coalesce(opened, F.lit(False))).unionByName(deeper)
    return events.join(hits.drop("_up", "_down"), [*keys, "_pos"]).withColumn("_hit", F.when(F.col("_hit._seg") <= limit, F.col("_hit")))


def _near_touch(events: DataFrame, max_holding: int) -> DataFrame:
    """``_hit`` and ``_last`` as in ``_first_touch``, of events that carry their own bar and the next ``max_holding`` as ``_ahead``."""
    touches = F.filter(F.slice("_ahead", 2, max_holding), lambda b: (b["px"] >= F.col("_up")) | (b["px"] <= F.col("_down")))
    last = F.get("_ahead", (F.col("_limit") - F.col("_pos")).cast("int"))
    return events.withColumns({"_hit": F.get(touches, F.lit(0)), "_last": last})


def _segments(numbers: Column, level: int, is_last: bool) -> Column:
    return F.transform(numbers, lambda s: F.struct(F.lit(level).alias("_level"), s.alias("_seg"), F.lit(is_last).alias("_is_last")))


def _outcome(events: DataFrame, vertical_weight: float) -> DataFrame:
    """Labels from the first barrier touch of each event row; the upper barrier is tested first."""
    p0 = F.col("_px")
    hit = F.struct(F.col("_hit.ts").alias("ts"), F.col("_hit.px").alias("px"))
    df = events.withColumn("_exit", F.when(F.col("_hit").isNull(), F.col("_last")).otherwise(hit))
    ret = (F.col("_exit.px") - p0) / p0
    kind = (
        F.when(F.col("_hit").isNull(), "vertical").when(F.col("_hit.px") >= F.col("_up"), "upper").otherwise("lower")
    )
    return (
        df.withColumn("t0", F.col("_ts"))
        .withColumn("t1", F.col("_exit.ts"))
        .withColumn("return_at_touch", ret)
        .withColumn("barrier_type", kind)
        .withColumn(
            "label",
            F.when(F.col("barrier_type") == "upper", 1)
            .when(F.col("barrier_type") == "lower", -1)
            .otherwise(F.signum("return_at_touch"))
            .cast("int"),
        )
        .withColumn(
            "raw_weight",
            F.abs("return_at_touch") * F.when(F.col("barrier_type") == "vertical", vertical_weight).otherwise(1.0),
        )
    )


def barrier_labels(
    bars: DataFrame,
    events: DataFrame | None = None,
    pt: float = 2.0,
    sl: float = 2.0,
    max_holding: int = 20,
    vol_window: int = VOL_WINDOW,
    vol_floor: float = VOL_FLOOR,
    vertical_weight: float = VERTICAL_WEIGHT,
    spacing: int = 1,
    min_events: int = MIN_EVENTS,
    price: str = "close",
    spec: SeriesSpec = DAILY,
    with_features: Sequence[str] = (),
) -> DataFrame:
    """Label events by the first barrier their price path touches.

    Events are given as (ticker, t0[, sigma]) or, by default, chosen by position, see
    ``label_candidates``.  An event whose t0 is no bar time has no label.  Bars
    beyond the end of a series shorten the holding period.

    Other columns of the bars are carried along.  ``with_features`` names price features (see ``features.add_price_features``),
    or ``close``, that each event gets as of t0: they come from the same pass over the bars, whose columns they are made of are not carried.

    Up to 16 bars of holding period stand beside the entry bar (the rows are in order there), and bars at which no event starts
    go no further; longer periods are searched by ``_first_touch``.
    """
    keys = list(spec.keys)
    near = max_holding <= BRANCH
    needed = parts_of(with_features)
    extra = [c for c in bars.columns if c not in (*keys, spec.ts, price, *needed)]
    if events is not None:
        wanted = events.withColumnRenamed("t0", spec.ts).withColumn("_wanted", F.lit(True))
        wanted = wanted.select(*keys, spec.ts, "_wanted", *[c for c in ("sigma",) if c in events.columns])
        bars = bars.join(wanted, [*keys, spec.ts], "left")
    lookback = max(vol_window, VOL_WINDOW, *MOMENTUM_WINDOWS) if needed else vol_window
    blocks = block_series(bars, lookback + 1, max_holding if near else 0, spec).in_order()
    w = blocks.window()
    change = F.log(F.try_divide(F.col(price), F.lag(price).over(w)))
    df = blocks.df.withColumns({"_lr": change, "_pos": blocks.position(), "_length": blocks.series_length(), **price_steps(w, needed)})
    if near:
        bar = F.struct(F.col(spec.ts).alias("ts"), F.col(price).alias("px"))
        df = df.withColumn("_ahead", F.array(bar, *[F.lead(bar, k).over(w) for k in range(1, max_holding + 1)]))
    if events is None:
        keep = _candidate(max_holding, vol_window, spacing, min_events)
    else:
        keep = F.coalesce(F.col("_wanted"), F.lit(False))
    stats = [Rolling("_vol", "stddev_samp", "_lr", vol_window, 1, 5), *price_rolls(needed)]
    if near:
        made = [c for c in (*price_steps(w, needed), "_wanted", "sigma") if c in df.columns and c != "_delta"]
        carried = [*keys, spec.ts, price, "_pos", "_length", "_ahead", *extra, *made]
        df = blocks.rolled(df, stats, only=blocks.own_rows() & keep, carried=carried)
    else:
        df = blocks.rolled(df, stats)
    df = with_price_features(df, needed)
    sigma = F.col("sigma") if events is not None and "sigma" in events.columns else F.col("_vol")
    placed = df.where(blocks.own_rows()).select(
        *keys,
        F.col(spec.ts).alias("_ts"),
        F.col(price).alias("_px"),
        "_pos",
        F.when(
            keep,
            F.struct(
                F.least(F.col("_pos") + max_holding, F.col("_length") - 1).alias("_limit"),
                F.when(sigma.isNotNull(), F.greatest(sigma, F.lit(vol_floor))).alias("sigma_t0"),
                *extra,
                *with_features,
                *(["_ahead"] if near else []),
            ),
        ).alias("_event"),
    )
    placed = placed if near else stage(placed, "positions")
    chosen = placed.where("_event is not null").select(*keys, "_ts", "_px", "_pos", "_event.*")
    p0, move = F.col("_px"), F.col("sigma_t0")
    chosen = chosen.withColumns({"_up": p0 * (1.0 + pt * move), "_down": p0 * (1.0 - sl * move)})
    touched = _near_touch(chosen, max_holding) if near else _first_touch(placed.drop("_event"), chosen, keys, max_holding)
    return _outcome(touched, vertical_weight).select(*keys, *LABEL_COLUMNS, *extra, *with_features)


def with_overlap_counts(
    labels: DataFrame, t0: str = "t0", t1: str = "t1", keys: tuple[str, ...] = (), name: str = "concurrency"
) -> DataFrame:
    """Number of windows that overlap each row's own window, itself included.

    A window overlaps ``[t0, t1]`` unless it starts after t1 or ends before t0, so the
    count is (starts up to t1) - (ends before t0): two lookups in running totals
    over the distinct moments, and no pair of windows is ever formed.
    """
    keys = list(keys)
    one, zero = F.lit(1), F.lit(0)
    moments = (
        labels.select(*keys, F.explode(F.array(
            F.struct(F.col(t0).alias("_at"), one.alias("_s"), zero.alias("_e")),
            F.struct(F.col(t1).alias("_at"), zero.alias("_s"), one.alias("_e")),
        )).alias("_m"))
        .groupBy(*keys, F.col("_m._at").alias("_at"))
        .agg(F.sum("_m._s").alias("_s"), F.sum("_m._e").alias("_e"))
    )
    totals = running_totals(moments, "_at", ["_s", "_e"], keys)
    started = totals.select(*keys, F.col("_at").alias(t1), F.col("_s_cum").alias("_started"))
    ended = totals.select(*keys, F.col("_at").alias(t0), (F.col("_e_cum") - F.col("_e")).alias("_ended"))
    return (
        labels.join(started, [*keys, t1])
        .join(ended, [*keys, t0])
        .withColumn(name, F.greatest(F.col("_started") - F.col("_ended"), F.lit(1)))
        .drop("_started", "_ended")
    )


def with_uniqueness(labels: DataFrame, scope: str = "market") -> DataFrame:
    """``uniqueness_weight``: one over the overlap count, over all tickers or per ticker."""
    if scope not in ("market", "ticker"):
        raise ValueError("scope must be 'market' or 'ticker'")
    counted = with_overlap_counts(labels, keys=("ticker",) if scope == "ticker" else ())
    return counted.withColumn("uniqueness_weight", 1.0 / F.col("concurrency")).drop("concurrency")


def with_sample_weights(
    labels: DataFrame, normalize: bool = True, raw_weight: str = "raw_weight", scope: str = "market"
) -> DataFrame:
    """``sample_weight``: uniqueness times return size, summing to one unless all are zero."""
    weighted = with_uniqueness(labels, scope).withColumn("_w", F.col("uniqueness_weight") * F.col(raw_weight))
    if not normalize:
        return weighted.withColumnRenamed("_w", "sample_weight")
    total = weighted.agg(F.sum("_w")).scalar()
    return weighted.withColumn("_total", total).withColumn(
        "sample_weight", F.when(F.col("_total") > 1e-12, F.col("_w") / F.col("_total")).otherwise(F.col("_w"))
    ).drop("_w", "_total")


def label_universe(
    bars: DataFrame,
    pt: float = 2.0,
    sl: float = 2.0,
    max_holding: int = 20,
    vol_window: int = VOL_WINDOW,
    min_events: int = MIN_EVENTS,
    spacing: int = 1,
    scope: str = "market",
    spec: SeriesSpec = DAILY,
    with_features: Sequence[str] = (),
) -> DataFrame:
    """Labels and weights for all tickers.

    The labels are staged: the weights read them four times.
    """
    labels = barrier_labels(
        bars, None, pt, sl, max_holding, vol_window, spacing=spacing, min_events=min_events, spec=spec, with_features=with_features
    )
    return with_sample_weights(stage(labels, "labels"), scope=scope)


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label", "barrier_type").agg(F.count(F.lit(1)).alias("n"))
