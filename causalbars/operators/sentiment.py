"""Bar-interval inference and decayed sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.functions.exprs import MICROS, seconds
from causalbars.plans.quantiles import exact_quantiles
from causalbars.plans.staging import stage
from causalbars.plans.series import DAILY, SeriesSpec, block_series, ordered_parts, running_in_parts

# Decay horizon in bars, decay rate, fallback bar interval.
DECAY_BARS = 12
DECAY_RATE = 3.0
FALLBACK_SECONDS = 300.0

# Order of rows at one moment: a story is seen by a bar that looks back from it, and by one that looks back to it.
_FROM, _STORY, _UP_TO = 0, 1, 2


def bar_interval(bars: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """One row: the median over tickers of the median time between bars, in seconds."""
    blocks = block_series(bars.select(*spec.keys, spec.ts), 1, spec=spec)
    gap = (F.unix_micros(spec.ts) - F.lag(F.unix_micros(spec.ts)).over(blocks.window())) / MICROS
    gaps = blocks.df.withColumn("gap", gap).where(blocks.own_rows())
    gaps = stage(gaps.select(*spec.keys, "gap"), "gaps")
    per_key = exact_quantiles(gaps, list(spec.keys), "gap", {"gap": F.lit(0.5)}, keep_empty=True)
    per_key = per_key.withColumn("gap", F.coalesce("gap", F.lit(FALLBACK_SECONDS)))
    overall = exact_quantiles(per_key, [], "gap", {"bar_seconds": F.lit(0.5)})
    return overall.agg(F.coalesce(F.max("bar_seconds"), F.lit(FALLBACK_SECONDS)).alias("bar_seconds"))


def neutral_sentiment(bars: DataFrame) -> DataFrame:
    return bars.withColumns(
        {
            "weighted_sentiment": F.lit(0.0),
            "sentiment_count": F.lit(0).cast("long"),
            "max_credibility": F.lit(0.0),
        }
    )


def merge_sentiment(
    bars: DataFrame,
    news: DataFrame,
    latency_seconds: float = 45,
    decay_bars: int = DECAY_BARS,
    bar_seconds: float | None = None,
    spec: SeriesSpec = DAILY,
) -> DataFrame:
    """Credibility-weighted sentiment that decays over ``decay_bars`` bars.

    A story counts for the bars from the moment it is usable, for ``decay_bars``
    bar intervals, both ends included.  ``(ticker, timestamp)`` identifies a bar.

    No bar meets a story.  Time is cut into cells as wide as the horizon, so what a bar sees is the beginning of its own
    cell up to the bar, and the end of the cell before from one horizon back.  Decay is a factor relative to the
    start of a cell, so both are running sums, from the front and from the back of the cells, of positive
    terms (nothing is subtracted).  They are accumulated in parts of the sorted rows: a bucket that holds most of
    the news is split as well.
    """
    keys = list(spec.keys)
    if bar_seconds is None:
        bar_seconds = bar_interval(bars, spec).first()["bar_seconds"]  # a single number
    horizon = round(bar_seconds * decay_bars * MICROS)
    max_age = max(bar_seconds * decay_bars, 1.0)
    width = max(horizon, 1)
    # How much less a story from the start of the row's cell weighs by now, and the inverse for a later story.
    since = (F.col("_now") - F.col("_cell") * width) / MICROS
    decay = F.exp(-DECAY_RATE * since / max_age)
    stories = (
        news.select(*keys, F.unix_micros(F.col("article_public_ts") + seconds(latency_seconds)).alias("_now"), "credibility", "headline_sentiment")
        .groupBy(*keys, "_now")
        .agg(
            F.sum(F.col("credibility") * F.col("headline_sentiment")).alias("_cs"),
            F.sum("credibility").alias("_c"),
            F.count(F.lit(1)).alias("_k"),
            F.max("credibility").alias("_m"),
        )
        .withColumn("_cell", F.floor(F.col("_now") / width))
        .withColumns({"_cs": F.col("_cs") / decay, "_c": F.col("_c") / decay})
        .select(*keys, "_cell", F.col("_now").alias("_at_time"), F.lit(_STORY).alias("_kind"), "_cs", "_c", "_k", "_m")
    )
    now = F.unix_micros(spec.ts)
    looks = [F.struct(now.alias("_at_time"), F.lit(_UP_TO).alias("_kind"))]
    if horizon:
        looks.append(F.struct((now - horizon).alias("_at_time"), F.lit(_FROM).alias("_kind")))
    looking = bars.where(F.col(spec.ts).isNotNull()).select(*keys, spec.ts, now.alias("_now"), F.inline(F.array(*looks)))
    looking = looking.withColumn("_cell", F.floor(F.col("_at_time") / width))
    rows = looking.unionByName(stories, allowMissingColumns=True)
    parts = ordered_parts(rows, [*keys, "_cell", "_at_time", "_kind"], "news-and-bars")
    found = None
    for kind, backward in ((_UP_TO, False), (_FROM, True)):
        run = running_in_parts(parts, [*keys, "_cell"], ["_cs", "_c", "_k"], ["_m"], backward).where(F.col("_kind") == kind)
        found = run if found is None else found.unionByName(run)
    weight = F.sum(decay * F.col("_c_run"))
    per_bar = found.where("_k_run > 0").groupBy(*keys, spec.ts).agg(
        F.when(weight > 1e-10, F.sum(decay * F.col("_cs_run")) / weight).alias("weighted_sentiment"),
        F.sum("_k_run").alias("sentiment_count"),
        F.max("_m_run").alias("max_credibility"),
    )
    return bars.join(per_bar, [*keys, spec.ts], "left").fillna(
        {"weighted_sentiment": 0.0, "sentiment_count": 0, "max_credibility": 0.0}
    )
