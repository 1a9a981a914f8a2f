"""Backward-looking per-ticker features, feature lookups and sequence windows."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.functions.exprs import floored, so_far
from causalbars.plans.series import DAILY, BlockedSeries, Rolling, SeriesSpec, block_series, drop_internal, numbered
from causalbars.plans.staging import stage

# Window lengths and names of the reference feature set.
VOL_WINDOW = 20
MOMENTUM_WINDOWS = (5, 20, 60)
ADV_WINDOW = 20
RSI_PERIOD = 14
Z_WINDOW = 60
EPS = 1e-8

RETURN_FEATURES = ("log_return", "realized_vol", "vol_norm_return")
TECHNICAL_FEATURES = ("momentum_5", "momentum_20", "momentum_60", "adv", "hl_spread", "rsi_14", "z_price")
SEQUENCE_FEATURES = (
    "vol_norm_return",
    "log_return",
    "realized_vol",
    "momentum_5",
    "momentum_20",
    "momentum_60",
    "rsi_14",
    "hl_spread",
    "weighted_sentiment",
)


def _log_return(w: WindowSpec, price: str) -> Column:
    return F.log(F.try_divide(F.col(price), F.lag(price).over(w)))


def _volatility(vol_window: int, min_count: int) -> Rolling:
    return Rolling("realized_vol", "stddev_samp", "log_return", vol_window, 1, min_count)


def _with_normed(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_norm_return", F.col("log_return") / floored(F.col("realized_vol"), EPS))


def _technical_steps(w: WindowSpec, price: str) -> dict[str, Column]:
    """Momentum, range and price change; looks 61 rows back."""
    last = F.lag(price).over(w)
    steps = {f"momentum_{n}": F.log(F.try_divide(last, F.lag(price, n + 1).over(w))) for n in MOMENTUM_WINDOWS}
    steps["hl_spread"] = (F.col("high") - F.col("low")) / F.greatest(F.col(price), F.lit(EPS))
    return {**steps, "_delta": last - F.lag(price, 2).over(w)}


def _technical_rolls(price: str) -> list[Rolling]:
    delta = F.col("_delta")
    gain, loss = (F.when(delta.isNotNull(), F.greatest(d, F.lit(0.0))) for d in (delta, -delta))
    # Simple means over the last 14 price changes, all of which must be known.
    return [
        Rolling("adv", "avg", "volume", ADV_WINDOW, 1, 5),
        Rolling("_z_mean", "avg", price, Z_WINDOW),
        Rolling("_z_std", "stddev_samp", price, Z_WINDOW, 1, 10),
        Rolling("_gain", "avg", gain, RSI_PERIOD - 1, 0, RSI_PERIOD),
        Rolling("_loss", "avg", loss, RSI_PERIOD - 1, 0),
    ]


def _with_technicals(df: DataFrame, price: str, needed: Collection[str] = TECHNICAL_FEATURES) -> DataFrame:
    """RSI and z-score from the rolling statistics."""
    if "z_price" in needed:
        df = df.withColumn("z_price", (F.col(price) - F.col("_z_mean")) / floored(F.col("_z_std"), EPS))
    if "rsi_14" in needed:
        df = df.withColumn("rsi_14", 100.0 - 100.0 / (1.0 + F.col("_gain") / floored(F.col("_loss"), EPS)))
    return df.drop("_delta", "_z_mean", "_z_std", "_gain", "_loss")


def add_return_features(
    bars: DataFrame,
    price: str = "close",
    vol_window: int = VOL_WINDOW,
    min_count: int = 5,
    spec: SeriesSpec = DAILY,
    at: DataFrame | None = None,
) -> DataFrame:
    """``log_return``, ``realized_vol`` and ``vol_norm_return`` per ticker; for ``at`` see ``add_price_features``."""
    blocks = block_series(bars, vol_window + 1, spec=spec).in_order()
    df = blocks.df.withColumn("log_return", _log_return(blocks.window(), price))
    return _finish(blocks, _with_normed(blocks.rolled(df, [_volatility(vol_window, min_count)], at)))


def add_technical_features(bars: DataFrame, price: str = "close", spec: SeriesSpec = DAILY) -> DataFrame:
    """Momentum, ADV, high-low spread, RSI and price z-score per ticker."""
    blocks = block_series(bars, max(MOMENTUM_WINDOWS) + 1, spec=spec).in_order()
    df = blocks.df.withColumns(_technical_steps(blocks.window(), price))
    return _finish(blocks, _with_technicals(blocks.rolled(df, _technical_rolls(price)), price))


#: What a feature is made of besides the price: columns of the bars, steps and rolling statistics.
_MADE_OF = {
    "realized_vol": ("log_return",),
    "vol_norm_return": ("log_return", "realized_vol"),
    "adv": ("volume",),
    "hl_spread": ("high", "low"),
    "rsi_14": ("_delta", "_gain", "_loss"),
    "z_price": ("_z_mean", "_z_std"),
}


def parts_of(names: Collection[str]) -> set[str]:
    """Price features with the columns, steps and rolling statistics that they are made of."""
    return {*names, *[part for n in names for part in _MADE_OF.get(n, ())]}


def price_steps(w: WindowSpec, needed: Collection[str]) -> dict[str, Column]:
    """The steps among ``needed``, over the rows of a series in order."""
    steps = {"log_return": _log_return(w, "close"), **_technical_steps(w, "close")}
    return {n: c for n, c in steps.items() if n in needed}


def price_rolls(needed: Collection[str], vol_window: int = VOL_WINDOW) -> list[Rolling]:
    return [r for r in (_volatility(vol_window, 5), *_technical_rolls("close")) if r.name in needed]


def with_price_features(df: DataFrame, needed: Collection[str]) -> DataFrame:
    """The features among ``needed`` that are made of rolling statistics of the same row."""
    return _with_technicals(_with_normed(df) if "vol_norm_return" in needed else df, "close", needed)


def add_price_features(
    bars: DataFrame,
    vol_window: int = VOL_WINDOW,
    spec: SeriesSpec = DAILY,
    at: DataFrame | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Return and technical features in one pass over one distribution of the rows.

    Who joins the features with events gives their (ticker, t0) as ``at``: all those rows come, and few others.  ``only``
    names the columns wanted besides key and time; Catalyst cannot leave out what a batch step makes or carries.
    """
    names = [*RETURN_FEATURES, *TECHNICAL_FEATURES] if only is None else list(only)
    needed = parts_of(names)
    if only is not None:
        bars = bars.select(*spec.keys, spec.ts, *[c for c in bars.columns if c in {"close", *needed} - {*spec.keys, spec.ts}])
    blocks = block_series(bars, max(vol_window, *MOMENTUM_WINDOWS) + 1, spec=spec).in_order()
    df = blocks.df.withColumns(price_steps(blocks.window(), needed))
    rolls = price_rolls(needed, vol_window)
    if rolls:
        df = blocks.rolled(df, rolls, at)
    df = _finish(blocks, with_price_features(df, needed))
    return df if only is None else df.select(*spec.keys, spec.ts, *names)


def _finish(blocks: BlockedSeries, df: DataFrame) -> DataFrame:
    return drop_internal(df.where(blocks.own_rows()))


def build_feature_matrix(
    bars: DataFrame,
    news: DataFrame | None = None,
    regimes: DataFrame | None = None,
    latency_seconds: float = 45,
    vol_window: int = VOL_WINDOW,
    spec: SeriesSpec = DAILY,
    at: DataFrame | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """All features per bar; rows still warming up are left out.

    ``at`` and ``only`` name the rows and price features asked for, see ``add_price_features``; with news, which look at all
    bars, ``at`` is not used.

    ``regimes`` is a (timestamp, regime) table, see ``regime.regime_labels``;
    without it, and without news, the columns take their neutral value 0.
    """
    from causalbars.operators.sentiment import merge_sentiment, neutral_sentiment

    if only is not None:
        only = list(dict.fromkeys([*only, "realized_vol", "momentum_60"]))
    df = add_price_features(bars, vol_window, spec, at if news is None else None, only)
    if regimes is None:
        df = df.withColumn("regime", F.lit(0))
    else:
        df = df.join(regimes.select("timestamp", "regime"), "timestamp", "left").fillna(0, ["regime"])
    if news is None:
        df = neutral_sentiment(df)
    else:
        # staged: the merge reads bar times for the interval and the join besides the rows
        df = merge_sentiment(stage(df, "price-features"), news, latency_seconds, spec=spec)
    return df.dropna(subset=["realized_vol", "momentum_60"])


def lookup_features(
    events: DataFrame, features: DataFrame, columns: Sequence[str] = ("regime", "vol_norm_return"), default: float = 0
) -> DataFrame:
    """Feature values at each event's (ticker, t0), ``default`` where unknown."""
    at = features.select("ticker", F.col("timestamp").alias("t0"), *columns)
    joined = events.drop(*columns).join(at, ["ticker", "t0"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def encode_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number the sorted distinct values of ``column`` from 0: (column, name); null is not a value."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return numbered(distinct, [column], name)


def with_encoded(df: DataFrame, column: str, name: str, ids: DataFrame) -> DataFrame:
    """Attach ids; values never seen by ``encode_ids`` map to 0."""
    return df.join(ids, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


def sequence_windows(
    events: DataFrame,
    features: DataFrame,
    columns: Sequence[str] = SEQUENCE_FEATURES,
    length: int = 30,
    spec: SeriesSpec = DAILY,
) -> DataFrame:
    """Per event the last ``length`` feature rows strictly before t0, oldest first.

    Shorter histories are padded with zero rows on the left; events with fewer
    than ``length // 2`` rows are left out.  Adds ``n_rows`` and ``sequence``
    (array of arrays).
    """
    series = spec.at("_ts")
    keys, names = list(spec.keys), [f"_x{i}" for i in range(len(columns))]
    rows = features.select(
        *keys,
        F.col(spec.ts).alias("_ts"),
        *[F.col(c).cast("float").alias(x) for c, x in zip(columns, names, strict=True)],
        F.lit(1).alias("_is_row"),
    )
    probes = events.select(
        *keys, F.col("t0").alias("_ts"), F.struct(*events.columns).alias("_event"), F.lit(0).alias("_is_row")
    )
    both = probes.unionByName(rows, allowMissingColumns=True)
    # Events sort before a row of the same time, so the rows before them are those of their window.
    blocks = block_series(both, length, spec=series, weight=F.col("_is_row")).in_order("_is_row")
    held = blocks.df.withColumn("_seen", F.sum("_is_row").over(so_far(blocks.window("_is_row"))).cast("long"))
    held = held.select("_event", "_seen", "_is_row", *names)
    schema = T.StructType(
        [
            held.schema["_event"],
            T.StructField("n_rows", T.IntegerType()),
            T.StructField("sequence", T.ArrayType(T.ArrayType(T.FloatType()))),
        ]
    )
    return held.mapInArrow(_windows_of(names, length), schema).select("_event.*", "n_rows", "sequence")


def _windows_of(names: list[str], length: int):
    """Windows of the feature rows before each event, of rows and events in the order of time; ``_seen`` counts a block's rows so far."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last rows of the batches before; a block's own are told by ``_seen``.
        x, known = np.zeros((length, len(names)), np.float32), np.zeros((length, len(names)), bool)
        for batch in batches:
            is_row = batch.column("_is_row").to_numpy() == 1
            rows = batch.filter(pa.array(is_row)).select(names).columns
            x = np.concatenate([x, np.stack([c.fill_null(0.0).to_numpy() for c in rows], axis=1)])
            known = np.concatenate([known, np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in rows], axis=1)])
            n_rows = np.minimum(batch.column("_seen").to_numpy(), length)
            # Rows of the batch before an event, behind those that were carried.
            ends = np.cumsum(is_row) + length
            found = np.flatnonzero(~is_row & (n_rows >= max(length // 2, 1)))
            step = max(1, (1 << 20) // (length * len(names)))
            for event in (found[i : i + step] for i in range(0, len(found), step)):
                at = ends[event, None] + np.arange(-length, 0)
                padded = np.arange(length) < (length - n_rows[event])[:, None]
                values = np.where(padded[:, :, None], np.float32(0), x[at])
                missing = ~padded[:, :, None] & ~known[at]
                flat = pa.array(values.reshape(-1), pa.float32(), mask=missing.reshape(-1))
                steps = pa.ListArray.from_arrays(np.arange(len(event) * length + 1, dtype=np.int32) * len(names), flat)
                cubes = pa.ListArray.from_arrays(np.arange(len(event) + 1, dtype=np.int32) * length, steps)
                out = [batch.column("_event").take(pa.array(event)), pa.array(n_rows[event].astype(np.int32)), cubes]
                yield pa.RecordBatch.from_arrays(out, ["_event", "n_rows", "sequence"])
            x, known = x[-length:], known[-length:]

    return windows
