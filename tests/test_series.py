"""Blocked series, running totals, positions, as-of joins, quantiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causalbars.plans.quantiles import exact_quantiles
from causalbars.plans.series import (
    Rolling,
    SeriesSpec,
    asof_join,
    block_series,
    global_position,
    ordered_parts,
    running_in_parts,
    running_totals,
)

TINY_BLOCKS = [
    SeriesSpec(span_seconds=3_600, rows_per_block=7),
    SeriesSpec(span_seconds=86_400, rows_per_block=40),
    SeriesSpec(span_seconds=30 * 86_400, rows_per_block=25),
    SeriesSpec(span_seconds=10**9, rows_per_block=10**6),
]


@pytest.mark.parametrize("spec", TINY_BLOCKS)
@pytest.mark.parametrize("back,ahead", [(5, 0), (0, 4), (11, 3)])
def test_blocks_equal_plain_windows(spark, bars, spec, back, ahead):
    blocks = block_series(bars, back, ahead, spec)
    w = blocks.window()
    frame = w.rowsBetween(-back, ahead)
    got = (
        blocks.df.withColumn("m", F.sum("close").over(frame))
        .withColumn("k", F.count("close").over(frame))
        .withColumn("pos", blocks.position())
        .withColumn("n", blocks.series_length())
        .where(blocks.own_rows())
        .select("ticker", "timestamp", "m", "k", "pos", "n")
        .toPandas()
    )
    plain = Window.partitionBy("ticker").orderBy("timestamp")
    want = (
        bars.withColumn("m", F.sum("close").over(plain.rowsBetween(-back, ahead)))
        .withColumn("k", F.count("close").over(plain.rowsBetween(-back, ahead)))
        .withColumn("pos", F.row_number().over(plain) - 1)
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
        .select("ticker", "timestamp", "m", "k", "pos", "n")
        .toPandas()
    )
    key = ["ticker", "timestamp"]
    pd.testing.assert_frame_equal(
        got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False
    )


def test_a_hot_series_is_spread_over_blocks(bars):
    blocks = block_series(bars, 5, spec=SeriesSpec(span_seconds=86_400, rows_per_block=50))
    sizes = blocks.df.where("ticker = 'K0'").groupBy("_block").count().toPandas()
    assert len(sizes) >= 6
    assert sizes["count"].max() < 120


def test_short_series_bring_no_counts(bars):
    """Series of one block each are not joined with counts of their spans, which grow with the rows."""
    plan = block_series(bars, 5).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("spec", [TINY_BLOCKS[1], TINY_BLOCKS[3]])
def test_rolled_equals_sliding_frames(spark, bars, spec):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        holes = F.when(F.col("volume") % 5 != 0, F.col("close"))
        blocks = block_series(bars.withColumn("x", holes), 12, spec=spec).in_order()
        stats = [Rolling("m", "avg", "x", 12, 1, 3), Rolling("s", "stddev_samp", "x", 5, 0), Rolling("v", "avg", F.col("volume"), 0, 0)]
        rolled = blocks.rolled(blocks.df, stats).where(blocks.own_rows())
        assert "rowframe, -12" not in rolled._jdf.queryExecution().optimizedPlan().toString().lower()
        got = rolled.select("ticker", "timestamp", "m", "s", "v")
        w = Window.partitionBy("ticker").orderBy("timestamp")
        back, here = w.rowsBetween(-12, -1), w.rowsBetween(-5, 0)
        want = bars.withColumn("x", holes).select(
            "ticker",
            "timestamp",
            F.when(F.count("x").over(back) >= 3, F.avg("x").over(back)),
            F.stddev_samp("x").over(here),
            "volume",
        )
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_equals_pandas(spark, bars, bars_pdf, direction, strict):
    rng = np.random.default_rng(3)
    hits = bars_pdf.sample(60, random_state=1)[["ticker", "timestamp"]]
    free = pd.DataFrame(
        {
            "ticker": rng.choice(["K0", "K1", "K2", "unknown"], 300),
            "timestamp": pd.Timestamp("2023-12-25") + pd.to_timedelta(rng.integers(0, 80 * 24 * 60, 300), unit="min"),
        }
    )
    probes = pd.concat([hits, free], ignore_index=True).rename(columns={"timestamp": "at"})
    probes["id"] = range(len(probes))
    got = asof_join(
        spark.createDataFrame(probes),
        bars,
        F.col("close"),
        "px",
        "at",
        direction=direction,
        strict=strict,
        spec=SeriesSpec(span_seconds=86_400, rows_per_block=9),
    ).toPandas()
    want = pd.merge_asof(
        probes.sort_values("at"),
        bars_pdf[["ticker", "timestamp", "close"]].sort_values("timestamp"),
        left_on="at",
        right_on="timestamp",
        by="ticker",
        direction=direction,
        allow_exact_matches=not strict,
    )
    a = got.set_index("id")["px"].sort_index()
    b = want.set_index("id")["close"].sort_index()
    assert len(a) == len(probes)
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float))


def test_running_totals_and_global_position(spark, bars, bars_pdf):
    counts = bars.groupBy("timestamp").agg(F.count(F.lit(1)).alias("c"))
    got = running_totals(counts, "timestamp", ["c"]).toPandas().sort_values("timestamp")
    assert (got["c_cum"].to_numpy() == got["c"].cumsum().to_numpy()).all()
    placed = global_position(bars, "timestamp", ["ticker"]).toPandas().sort_values(["timestamp", "ticker"])
    assert (placed["pos"].to_numpy() == np.arange(len(bars_pdf))).all()


@pytest.mark.parametrize("kind", ["normal", "ties", "one value", "outlier"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    x = {
        "normal": rng.normal(size=700),
        "ties": rng.integers(0, 4, 700).astype(float),
        "one value": np.full(50, 2.5),
        "outlier": np.append(rng.uniform(0, 1e-6, 500), 1e9),
    }[kind]
    pdf = pd.DataFrame({"g": np.arange(len(x)) % 3, "x": x})
    df = spark.createDataFrame(pdf)
    levels = {"lo": 0.1, "mid": 0.5, "hi": 0.999, "min": 0.0, "max": 1.0}
    cols = {k: F.lit(v) for k, v in levels.items()}
    one = exact_quantiles(df, [], "x", cols).first()
    for k, v in levels.items():
        assert one[k] == pytest.approx(np.quantile(x, v), rel=1e-12, abs=1e-15)
    for row in exact_quantiles(df, ["g"], "x", cols).collect():
        part = pdf.loc[pdf.g == row["g"], "x"].to_numpy()
        assert row["n"] == len(part)
        for k, v in levels.items():
            assert row[k] == pytest.approx(np.quantile(part, v), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_approximate_cuts_are_computed_once(spark, keys):
    """Sketches that are merged in another order give other cuts: a second computation would not fit the first."""
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    plan = exact_quantiles(df, keys, "x", {"mid": F.lit(0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" not in plan


def test_dense_span_is_split(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit("hot").alias("ticker"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7).alias("timestamp"), "id"
    )
    blocks = block_series(rows, 3, spec=SeriesSpec(span_seconds=86_400, rows_per_block=1_000))
    held = blocks.df.groupBy("ticker", "_block").count().agg(F.max("count"), F.count("*")).first()
    assert held[0] <= 3_000 and held[1] >= 100
    placed = blocks.df.withColumn("pos", blocks.position()).withColumn("back", F.lag("id", 3).over(blocks.window()))
    own = placed.where(blocks.own_rows())
    assert own.count() == n
    assert own.where("pos <> id or (id >= 3 and back <> id - 3) or (id < 3 and back is not null)").count() == 0


def test_one_hot_moment_is_no_group(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") < 1000, F.lit(500)).otherwise(F.col("id")).alias("ts"), (F.lit(5000) - F.col("id")).alias("tie")
    )
    got = global_position(rows, "ts", ["tie"]).toPandas().sort_values(["ts", "tie"])
    assert (got["pos"].to_numpy() == np.arange(2000)).all()
    parts = ordered_parts(rows, ["ts", "tie"]).groupBy("_part").count()
    assert parts.agg(F.max("count")).first()[0] < 1000


def test_running_aggregates_over_parts(spark):
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame({"k": np.where(np.arange(n) < 350, 7, rng.integers(0, 5, n)), "t": rng.permutation(n), "x": rng.normal(size=n)})
    pdf.loc[::9, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("y", F.col("x"))
    parts = ordered_parts(df, ["k", "t"])
    for backward in (False, True):
        got = running_in_parts(parts, ["k"], ["x"], ["y"], backward).toPandas().sort_values(["k", "t"], ascending=not backward)
        by_key = pdf.sort_values(["k", "t"], ascending=not backward).groupby("k").x
        want_sum, want_max = by_key.transform(lambda s: s.expanding().sum()), by_key.transform(lambda s: s.expanding().max())
        np.testing.assert_allclose(got.x_run.to_numpy(float), want_sum.to_numpy(), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(got.y_run.to_numpy(float), want_max.to_numpy())
