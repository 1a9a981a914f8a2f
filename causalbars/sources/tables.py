"""Bars, news, lifecycles and predictions derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.sources.bars import bars_from_ticks, packed_order, with_usable_after


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instrument: key, ticker and sector."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("s_suppkey").alias("instrument"), F.col("s_name").alias("ticker"), F.col("r_name").alias("sector"))
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: each order line is a tick of its supplier's instrument.

    Ticks are aggregated on the numeric key first; only bars meet the
    instrument table.
    """
    ticks = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    order = packed_order(("l_orderkey", 15), ("l_linenumber", 2), ("l_partkey", 11), (cents, 10))
    bars = bars_from_ticks(ticks, 86_400, order, key="instrument")
    return bars.join(instruments(spark, sf_dir), "instrument")


def _event_ticker(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click, view and purchase events with a positive value, as ticks."""
    events = table(spark, sf_dir, "events").where(
        F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 0)
    )
    return _event_ticker(events).select(
        "ticker", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id"
    )


def intraday_bars(spark: SparkSession, sf_dir: str, seconds: int = 3_600) -> DataFrame:
    """Hourly bars, or bars of other length, from the event ticks; the volume counts ticks."""
    return bars_from_ticks(event_ticks(spark, sf_dir), seconds, packed_order((F.unix_micros("ts"), 17), ("event_id", 18)), size=F.lit(1.0))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup and error events as news with a sentiment and a credibility."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    k = F.get_json_object("props", "$.k").cast("double")
    rows = _event_ticker(events).select(
        "event_id",
        "ticker",
        F.col("ts").cast("timestamp").alias("article_public_ts"),
        (k / 49.5 - 1.0).alias("headline_sentiment"),
        (0.1 + 0.9 * (F.col("event_id") % 10).cast("double") / 9.0).alias("credibility"),
    )
    return with_usable_after(rows)


def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing dates per instrument; every tenth instrument is unregistered."""
    lines = table(spark, sf_dir, "lineitem")
    span = lines.groupBy(F.col("l_suppkey").alias("instrument")).agg(
        F.min("l_shipdate").cast("timestamp").alias("first"), F.max("l_shipdate").cast("timestamp").alias("last")
    )
    days90 = F.make_dt_interval(F.lit(90))
    return (
        span.where(F.col("instrument") % 10 != 9)
        .join(instruments(spark, sf_dir), "instrument")
        .select(
            "ticker",
            "instrument",
            (F.col("first") + days90).alias("ipo_date"),
            F.when(F.col("instrument") % 3 == 0, F.col("last") - days90).alias("delist_date"),
            "sector",
        )
    )


def with_predictions(labels: DataFrame, instrument: str = "instrument") -> DataFrame:
    """Deterministic quantile forecasts for labelled events."""
    day_no = F.datediff(F.to_date("t0"), F.lit("1970-01-01").cast("date"))
    p50 = 0.01 * ((F.col(instrument) * 7 + day_no) % 21 - 10)
    return (
        labels.withColumn("p50", p50.cast("double"))
        .withColumn("p10", F.col("p50") - 0.3)
        .withColumn("p90", F.col("p50") + 0.3)
    )
