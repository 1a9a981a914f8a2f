"""Store, session filter, universe, contracts, guards."""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.operators import contracts, guards, universe
from causalbars.plans.series import SeriesSpec
from causalbars.plans.staging import shared_dir, stage
from causalbars.sources import bars as bar_source
from causalbars.sources.store import BarStore, union_slices

def T0(text):
    return pd.Timestamp(text).to_pydatetime()


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_store_round_trip_and_range(spark, tmp_path, bars, bars_pdf, fmt):
    store = BarStore(spark, str(tmp_path / fmt), fmt, bars.schema)
    store.write(bars)
    assert store.read().count() == len(bars_pdf)
    lo, hi = pd.Timestamp("2024-01-10 05:00"), pd.Timestamp("2024-02-03 00:00")
    found = store.read_range(lo.to_pydatetime(), "2024-02-03 00:00:00", ["K0", "K1"])
    want = bars_pdf[bars_pdf.timestamp.between(lo, hi) & bars_pdf.ticker.isin(["K0", "K1"])]
    got = found.select("timestamp", "ticker", "close").toPandas()
    want = want.sort_values(["timestamp", "ticker"])[["timestamp", "ticker", "close"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert store.read_range(tickers=[]).count() == len(bars_pdf)


def test_range_read_prunes_partitions(spark, tmp_path, bars):
    store = BarStore(spark, str(tmp_path / "p"))
    store.write(bars)
    plan = store.read_range("2024-02-01", "2024-02-10", ["K0"])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in filters and "month" in filters
    assert "timestamp" in plan.split("PushedFilters: [")[1] and "ticker" in plan.split("PushedFilters: [")[1]


def test_empty_write_and_bad_format(spark, tmp_path, bars):
    store = BarStore(spark, str(tmp_path / "e"), schema=bars.schema)
    store.write(bars.limit(0))
    with pytest.raises(ValueError):
        BarStore(spark, str(tmp_path), "orc")


def test_other_partitioning(spark, tmp_path, bars, bars_pdf):
    store = BarStore(spark, str(tmp_path / "s"))
    store.write(bars, ["sector"])
    assert store.read_range("2024-01-01", tickers=["K0"]).count() == 400


def test_union_of_slices_fills_missing_columns(spark):
    a = frame(spark, [("A", 1.0)], "ticker string, x double")
    b = frame(spark, [("B",)], "ticker string")
    assert {(r.ticker, r.x) for r in union_slices(a, b).collect()} == {("A", 1.0), ("B", None)}


def test_session_and_flags(spark):
    rows = [(T0(t),) for t in ("2024-01-05 09:29", "2024-01-05 09:30", "2024-01-05 15:59", "2024-01-05 16:00", "2024-01-06 10:00")]
    df = frame(spark, rows, "timestamp timestamp")
    assert [r[0].minute for r in bar_source.trading_session(df).orderBy("timestamp").collect()] == [30, 59]
    b = frame(spark, [(T0("2024-01-05"), None), (T0("2024-01-05"), T0("2024-01-05")), (T0("2024-01-04"), T0("2024-01-05"))],
              "timestamp timestamp, delist_date timestamp")
    assert sorted(r.is_active for r in bar_source.with_activity_flag(b).collect()) == [False, True, True]


def lifecycles(spark):
    return frame(
        spark,
        [("OLD", T0("2010-01-01"), T0("2023-07-01")), ("NEW", T0("2023-07-01"), None)],
        "ticker string, ipo_date timestamp, delist_date timestamp",
    )


def test_universe(spark):
    lc = lifecycles(spark)
    got = universe.active_universe(lc, ["2023-01-01", "2023-07-01", dt.date(2023, 7, 2)]).collect()
    assert [(r.as_of.month, r.as_of.day, r.ticker) for r in got] == [
        (1, 1, "OLD"), (7, 1, "NEW"), (7, 1, "OLD"), (7, 2, "NEW")
    ]
    probe = frame(
        spark,
        [("OLD", T0("2023-03-01")), ("OLD", T0("2023-09-01")), ("NEW", T0("2023-03-01")), ("NEW", T0("2023-09-01")), ("??", T0("2023-03-01"))],
        "ticker string, timestamp timestamp",
    )
    assert universe.filter_to_universe(probe, lc).count() == 3
    assert universe.filter_to_universe(probe, lc, strict=True).count() == 2
    assert [r.ticker for r in universe.delisted_tickers(lc).collect()] == ["OLD"]
    assert universe.lifecycle_of(lc, "NEW").count() == 1 and universe.all_tickers(lc).count() == 2
    again = lc.withColumn("version", F.lit(1)).unionByName(
        lc.where("ticker = 'OLD'").withColumns({"version": F.lit(2), "delist_date": F.lit(None).cast("timestamp")})
    )
    latest = {r.ticker: r.delist_date for r in universe.upsert_lifecycles(again).collect()}
    assert latest == {"OLD": None, "NEW": None}


def test_market_contract(spark, bars):
    assert contracts.validate(bars, contracts.market_contract()) is bars
    broken = bars.withColumn("high", F.when(F.col("ticker") == "K2", F.col("low") - 1).otherwise(F.col("high")))
    with pytest.raises(contracts.ContractError, match="high must be >= low .3 rows."):
        contracts.validate(broken, contracts.market_contract())
    good, bad = contracts.split_quarantine(broken, contracts.market_contract())
    assert bad.count() == 3 and good.count() == 490
    with pytest.raises(contracts.ContractError, match="missing column"):
        contracts.validate(bars.drop("open"), contracts.market_contract())
    with pytest.raises(contracts.ContractError, match="volume has type"):
        contracts.validate(bars.withColumn("volume", F.col("volume").cast("int")), contracts.market_contract())


def test_other_contracts(spark):
    news = frame(
        spark,
        [("A", T0("2024-01-01"), T0("2024-01-02"), 0.5, 1.0), ("A", T0("2024-01-01"), T0("2024-01-01"), -1.5, None)],
        "ticker string, article_public_ts timestamp, usable_after_ts timestamp, headline_sentiment double, credibility double",
    )
    got = {r.rule: r.violations for r in contracts.violations(news, contracts.news_contract()).collect()}
    assert got["credibility is null"] == 1
    assert got["headline_sentiment must be in [-1, 1]"] == 1
    assert got["usable_after_ts must be after article_public_ts"] == 1
    labels = frame(
        spark,
        [(T0("2024-01-01"), T0("2024-01-02"), "A", 1, 0.1, 0.0), (T0("2024-01-02"), T0("2024-01-02"), "A", 2, 0.1, 1.0)],
        "t0 timestamp, t1 timestamp, ticker string, label int, return_at_touch double, sample_weight double",
    )
    got = {r.rule: r.violations for r in contracts.violations(labels, contracts.label_contract()).collect()}
    assert got["sample_weight must be positive"] == 1 and got["t1 must be after t0"] == 1
    assert got["label must be -1, 0 or 1"] == 1


def test_guards(spark):
    feats = frame(spark, [(1, T0("2024-01-02")), (2, T0("2024-01-02"))], "event_id int, timestamp timestamp")
    labels = frame(
        spark,
        [(1, T0("2024-01-01"), T0("2024-01-03")), (2, T0("2024-01-02"), T0("2024-01-03"))],
        "event_id int, t0 timestamp, t1 timestamp",
    )
    assert [r.event_id for r in guards.late_features(feats, labels).collect()] == [1]
    with pytest.raises(guards.LeakageError, match="dated after"):
        guards.assert_no_leakage(feats, labels)
    with pytest.raises(guards.LeakageError, match="end no later"):
        guards.assert_no_leakage(feats.drop("event_id"), labels.withColumn("t1", F.col("t0")))
    guards.assert_no_leakage(feats.drop("event_id"), labels)
    bars = frame(
        spark,
        [("A", T0("2024-01-01 10:00:10")), ("A", T0("2024-01-01 10:00:45")), ("A", T0("2024-01-01 10:00:00")), ("B", T0("2024-01-01 10:00:10"))],
        "ticker string, timestamp timestamp",
    )
    news = frame(spark, [("A", T0("2024-01-01 10:00:00"))] * 2, "ticker string, article_public_ts timestamp")
    assert [(r.ticker, r.violations) for r in guards.early_news(bars, news).collect()] == [("A", 2)]
    with pytest.raises(guards.LeakageError, match="reaction time"):
        guards.assert_no_leakage(bars, labels, news)


def test_arrival_order(spark):
    rows = [("A", 1, T0("2024-01-01")), ("A", 2, T0("2024-01-01")), ("A", 3, T0("2024-01-03")), ("B", 4, T0("2024-01-01")), ("A", 5, T0("2024-01-02"))]
    df = frame(spark, rows, "ticker string, seq int, timestamp timestamp")
    assert [r.seq for r in guards.out_of_order(df, "seq").collect()] == [5]
    assert sorted(r.seq for r in guards.out_of_order(df, "seq", ticker=None).collect()) == [4]
    with pytest.raises(guards.LeakageError):
        guards.assert_ordered(df, "seq")
    guards.assert_ordered(df.where("seq < 5"), "seq")


def test_staging_uses_the_named_folder(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named if named else shared_dir(spark).startswith("/tmp/")
    df = spark.range(10)
    assert stage(df, "x").count() == 10 and stage(df, "x").schema == T.StructType([T.StructField("id", T.LongType())])


def test_one_endless_wait_and_news_in_one_moment(spark):
    """A story that is never usable makes no pairs; counts equal the definition."""
    start = dt.datetime(2024, 1, 1)
    news = [("A", start + dt.timedelta(seconds=s % 50), start + dt.timedelta(seconds=s % 50 + 45)) for s in range(200)]
    news += [("A", start, start + dt.timedelta(days=9000)), ("B", start, start)]
    ticks = [("A", start + dt.timedelta(seconds=10 * i)) for i in range(60)] + [("B", start)]
    got = guards.early_news(
        spark.createDataFrame(ticks, "ticker string, timestamp timestamp"),
        spark.createDataFrame(news, "ticker string, article_public_ts timestamp, usable_after_ts timestamp"),
    )
    want = sum(t == k and p < at < u for t, at in ticks for k, p, u in news)
    assert [(r.ticker, r.violations) for r in got.collect()] == [("A", want)]


def test_packed_order_sorts_like_its_columns(spark):
    rows = [(a, b) for a in (0, 7, 99) for b in (0, 5, 123456)]
    packed = bar_source.packed_order(("a", 2), ("b", 6)).alias("k")
    df = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", packed)
    assert [(r.a, r.b) for r in df.orderBy("k").collect()] == sorted(rows)
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(100, 1)], "a bigint, b bigint").select(packed).collect()


def test_packed_order_is_made_of_numbers_without_text(spark):
    rows = [(a, b, Decimal(c)) for a in (0, 10**15 - 1) for b in (3, 99) for c in (0, 10**20 + 7)]
    df = spark.createDataFrame(rows, "a bigint, b int, c decimal(38,0)")
    got = df.select("a", "b", "c", bar_source.packed_order(("a", 15), ("b", 2), ("c", 21)).alias("k"))
    assert [int(r.k) for r in got.collect()] == [int(f"{a:015d}{b:02d}{int(c):021d}") for a, b, c in rows]
    assert "lpad" not in got._jdf.queryExecution().toString()
