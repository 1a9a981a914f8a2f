"""Point-in-time universe: who was listed when."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_alive(at: Column, ipo: Column | str = "ipo_date", delist: Column | str = "delist_date") -> Column:
    """Listed at ``at``; the listing and the delisting moment both count as listed."""
    ipo = F.col(ipo) if isinstance(ipo, str) else ipo
    delist = F.col(delist) if isinstance(delist, str) else delist
    return (at >= ipo) & (delist.isNull() | F.coalesce(at <= delist, F.lit(False)))


def active_universe(lifecycles: DataFrame, dates: Sequence[str | dt.date | dt.datetime]) -> DataFrame:
    """(as_of, ticker) for each of the given dates, ordered."""
    moments = F.array(*[F.lit(d).cast("timestamp") for d in dates])
    return (
        lifecycles.withColumn("as_of", F.explode(moments))
        .where(is_alive(F.col("as_of")))
        .select("as_of", "ticker")
        .orderBy("as_of", "ticker")
    )


def filter_to_universe(
    df: DataFrame, lifecycles: DataFrame, ts: str = "timestamp", ticker: str = "ticker", strict: bool = False
) -> DataFrame:
    """Rows whose ticker was listed at their time.

    Tickers without a lifecycle are kept, or dropped if ``strict``.  The
    join side is left to Catalyst, which broadcasts lifecycles while they are small.
    """
    dates = lifecycles.select(
        F.col("ticker").alias("_lc_ticker"), F.col("ipo_date").alias("_ipo"), F.col("delist_date").alias("_delist")
    )
    joined = df.join(dates, F.col(ticker) == F.col("_lc_ticker"), "inner" if strict else "left")
    alive = is_alive(F.col(ts), "_ipo", "_delist")
    return joined.where(F.col("_lc_ticker").isNull() | alive).drop("_lc_ticker", "_ipo", "_delist")


def lifecycle_of(lifecycles: DataFrame, ticker: str) -> DataFrame:
    return lifecycles.where(F.col("ticker") == ticker)


def all_tickers(lifecycles: DataFrame) -> DataFrame:
    return lifecycles.select("ticker")


def delisted_tickers(lifecycles: DataFrame) -> DataFrame:
    return lifecycles.where(F.col("delist_date").isNotNull()).select("ticker")


def upsert_lifecycles(registrations: DataFrame, version: str = "version") -> DataFrame:
    """One row per ticker, the latest registration winning."""
    others = [c for c in registrations.columns if c not in ("ticker", version)]
    latest = registrations.groupBy("ticker").agg(F.max_by(F.struct(*others), version).alias("_latest"))
    return latest.select("ticker", "_latest.*")
