"""Bars and news: session filter, tick aggregation, activity flag, news latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.functions.exprs import MICROS, seconds

# Trading session and reaction latency of the reference set-up.
SESSION_OPEN = "09:30"
SESSION_CLOSE = "16:00"
LATENCY_SECONDS = 45


def _minutes(clock: str) -> int:
    hours, minutes = clock.split(":")
    return int(hours) * 60 + int(minutes)


def trading_session(
    df: DataFrame, ts: str = "timestamp", open_: str = SESSION_OPEN, close: str = SESSION_CLOSE
) -> DataFrame:
    """Keep weekdays, ``open_ <= time of day < close``."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return df.where((F.weekday(ts) < 5) & (minute >= _minutes(open_)) & (minute < _minutes(close)))


def bars_from_ticks(
    ticks: DataFrame,
    interval_seconds: int,
    order: Sequence[str] | Column,
    key: str = "ticker",
    ts: str = "ts",
    price: str = "price",
    size: str | Column = "size",
) -> DataFrame:
    """OHLCV bars per key and interval; ``order`` decides first and last tick.

    Every aggregate combines on the map side, so a hot key costs no more
    shuffle than a cold one.  ``order`` is a list of columns, or one number that
    tells ticks apart (see ``packed_order``): with a number Spark aggregates by hashing,
    with several columns it must sort the ticks.
    """
    step = interval_seconds * MICROS
    start = F.timestamp_micros((F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / step) * step).cast("long"))
    rank = order if isinstance(order, Column) else F.struct(*order)
    size = F.col(size) if isinstance(size, str) else size
    return ticks.groupBy(key, start.alias("timestamp")).agg(
        F.min_by(price, rank).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, rank).alias("close"),
        F.sum(size.cast("double")).alias("volume"),
    )


def packed_order(*digits: tuple[str | Column, int]) -> Column:
    """Whole, non-negative numbers as one 38-digit decimal that orders like the list of them.

    Each comes with the decimal digits it may have; a larger value, or more than 38 digits in all, is an error.
    """
    if sum(n for _, n in digits) > 38:
        raise ValueError("more than 38 digits")
    parts: list[tuple[Column, int]] = []
    for column, n in digits:
        c = F.col(column) if isinstance(column, str) else column
        if n > 18:
            c = c.cast("decimal(38,0)")
        below = F.lit(10**n) if n <= 18 else F.lit("1" + "0" * n).cast("decimal(38,0)")
        fits = (c >= 0) & (c < below)
        part = F.when(fits, c.cast("long") if n <= 18 else c).otherwise(F.raise_error(F.lit(f"a value does not fit in {n} digits")))
        if parts and parts[-1][1] + n <= 18:
            parts[-1] = parts[-1][0] * F.lit(10**n) + part, parts[-1][1] + n
        else:
            parts.append((part, n))
    number = F.lit(0).cast("decimal(1,0)")
    for part, n in parts:
        number = number * F.lit("1" + "0" * n).cast(f"decimal({min(n + 1, 38)},0)") + part.cast(f"decimal({n},0)")
    return number.cast("decimal(38,0)")


def with_activity_flag(bars: DataFrame, delisted: str | Column = "delist_date", ts: str = "timestamp") -> DataFrame:
    """``is_active``: not delisted, or still strictly before the delisting time."""
    delisted = F.col(delisted) if isinstance(delisted, str) else delisted
    return bars.withColumn("is_active", delisted.isNull() | F.coalesce(F.col(ts) < delisted, F.lit(False)))


def with_usable_after(
    news: DataFrame, latency_seconds: float = LATENCY_SECONDS, public: str = "article_public_ts"
) -> DataFrame:
    """``usable_after_ts``: the publication time plus the reaction latency."""
    return news.withColumn("usable_after_ts", F.col(public) + seconds(latency_seconds))
