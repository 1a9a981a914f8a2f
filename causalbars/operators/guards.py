"""Leakage guards: each returns its violations; ``assert_no_leakage`` raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.functions.exprs import MICROS, seconds
from causalbars.plans.series import DAILY, DAY, SeriesSpec, block_series, running_totals


class LeakageError(RuntimeError):
    """Information from after an event reached its features."""


def late_features(features: DataFrame, labels: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Feature rows dated after the t0 of the event they belong to (same ``event_id``)."""
    return features.select("event_id", F.col(ts)).join(labels.select("event_id", "t0"), "event_id").where(
        F.col(ts) > F.col("t0")
    )


def bad_horizons(labels: DataFrame) -> DataFrame:
    """Labels that end no later than they start."""
    return labels.where(F.col("t1") <= F.col("t0"))


def early_news(bars: DataFrame, news: DataFrame, latency_seconds: float = 45, ts: str = "timestamp") -> DataFrame:
    """(ticker, violations): bars strictly between publication and usability of a story.

    A usability column that is already there is used as it is.  The stories open at a bar are those published before it
    less those usable by then, two running totals, so neither a long wait nor dense news makes pairs.
    """
    if "usable_after_ts" not in news.columns:
        news = news.withColumn("usable_after_ts", F.col("article_public_ts") + seconds(latency_seconds))
    public, usable = F.unix_micros("article_public_ts"), F.unix_micros("usable_after_ts")
    waiting = news.where(usable - public > 1).select("ticker", public.alias("_p"), usable.alias("_u"))
    edges = [
        waiting.select("ticker", (F.col("_p") + 1).alias("_t"), F.lit(1).alias("_open"), F.lit(0).alias("_bars")),
        waiting.select("ticker", F.col("_u").alias("_t"), F.lit(-1).alias("_open"), F.lit(0).alias("_bars")),
        bars.select("ticker", F.unix_micros(ts).alias("_t"), F.lit(0).alias("_open"), F.lit(1).alias("_bars")),
    ]
    moments = edges[0].unionByName(edges[1]).unionByName(edges[2]).where(F.col("_t").isNotNull())
    moments = moments.groupBy("ticker", "_t").agg(F.sum("_open").alias("_open"), F.sum("_bars").alias("_bars"))
    day = F.floor(F.col("_t") / (DAY * MICROS))
    counted = running_totals(moments, "_t", ["_open"], keys=["ticker"], bucket=day)
    found = counted.groupBy("ticker").agg(F.sum(F.col("_bars") * F.col("_open_cum")).alias("violations"))
    return found.where(F.col("violations") > 0)


def out_of_order(
    df: DataFrame, sequence: str, ts: str = "timestamp", ticker: str | None = "ticker", spec: SeriesSpec = DAILY
) -> DataFrame:
    """Rows that arrived (by ``sequence``) after a later-dated row of their ticker.

    A DataFrame has no order of its own, so the order of arrival is a column.
    Comparing with the previous arrival only is enough to find a ticker out of order.
    """
    keys = (ticker,) if ticker else ("_all",)
    rows = df if ticker else df.withColumn("_all", F.lit(0))
    # spans of the arrival column: one "second" is a million arrivals
    series = SeriesSpec(keys, "_arrival", 1, spec.rows_per_block)
    blocks = block_series(rows.withColumn("_arrival", F.col(sequence).cast("long")), 1, spec=series)
    previous = F.lag(ts).over(blocks.window())
    late = blocks.df.withColumn("_previous", previous).where(blocks.own_rows() & (F.col("_previous") > F.col(ts)))
    return late.select(*df.columns, F.col("_previous").alias("previous_ts"))


def fold_overlaps(folds: DataFrame, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """(fold, violations): training windows that touch the test fold's t0 range."""
    test = folds.where(F.col("role") == "test")
    bounds = test.groupBy("fold").agg(F.min(t0).alias("_lo"), F.max(t0).alias("_hi"))  # one row per fold
    train = folds.where(F.col("role") == "train").join(F.broadcast(bounds), "fold")
    touches = (F.col(t0) <= F.col("_hi")) & (F.col(t1) >= F.col("_lo"))
    counted = train.groupBy("fold").agg(F.count_if(touches).alias("violations"))
    return bounds.select("fold").join(counted, "fold", "left").fillna(0, ["violations"])


def leakage_report(
    features: DataFrame,
    labels: DataFrame,
    news: DataFrame | None = None,
    latency_seconds: float = 45,
    ts: str = "timestamp",
) -> DataFrame:
    """(guard, violations) of every guard that the columns allow, zero included."""
    counts = []
    if "event_id" in features.columns and "event_id" in labels.columns:
        counts.append(("late_features", late_features(features, labels, ts), F.count(F.lit(1))))
    counts.append(("bad_horizons", bad_horizons(labels), F.count(F.lit(1))))
    if news is not None:
        counts.append(("early_news", early_news(features, news, latency_seconds, ts), F.sum("violations")))
    rows = [
        found.agg(F.coalesce(n, F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("guard"), "violations")
        for name, found, n in counts
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def assert_no_leakage(
    features: DataFrame,
    labels: DataFrame,
    news: DataFrame | None = None,
    latency_seconds: float = 45,
    ts: str = "timestamp",
) -> None:
    """Raise on late features, bad horizons or news seen too early, in that order."""
    if "event_id" in features.columns and "event_id" in labels.columns:
        n = late_features(features, labels, ts).count()
        if n:
            raise LeakageError(f"{n} feature rows are dated after their event")
    n = bad_horizons(labels).count()
    if n:
        raise LeakageError(f"{n} labels end no later than they start")
    if news is not None:
        n = early_news(features, news, latency_seconds, ts).agg(F.sum("violations")).first()[0] or 0
        if n:
            raise LeakageError(f"{n} bar/news pairs fall inside the {latency_seconds}s reaction time")


def assert_ordered(df: DataFrame, sequence: str, ts: str = "timestamp", ticker: str | None = "ticker") -> None:
    """Raise if a ticker's rows did not arrive in time order."""
    n = out_of_order(df, sequence, ts, ticker).count()
    if n:
        raise LeakageError(f"{n} rows arrived after a later-dated row")
