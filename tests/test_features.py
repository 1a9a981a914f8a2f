"""Features against a plain pandas statement of their definition."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalbars.operators import features, regime, sentiment
from causalbars.plans.series import SeriesSpec, global_position

SMALL = SeriesSpec(span_seconds=86_400, rows_per_block=80)


def expected(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, g in pdf.sort_values(["ticker", "timestamp"]).groupby("ticker"):
        g = g.copy()
        c = g["close"]
        past = c.shift(1)
        g["log_return"] = np.log(c) - np.log(past)
        g["realized_vol"] = [
            v.std(ddof=1) if (v := g["log_return"].iloc[max(0, i - 20) : i].dropna()).size >= 5 else np.nan
            for i in range(len(g))
        ]
        g["momentum_20"] = np.log(past) - np.log(c.shift(21))
        g["adv"] = [v.mean() if (v := g["volume"].iloc[max(0, i - 20) : i]).size >= 5 else np.nan for i in range(len(g))]
        rsi, z = [], []
        for i in range(len(g)):
            moves = np.diff(c.iloc[max(0, i - 15) : i].to_numpy())
            if len(moves) < 14:
                rsi.append(np.nan)
            else:
                up, down = moves[moves > 0].sum() / 14, -moves[moves < 0].sum() / 14
                rsi.append(100 - 100 / (1 + up / max(down, 1e-8)))
            v = c.iloc[max(0, i - 60) : i]
            z.append((c.iloc[i] - v.mean()) / max(v.std(ddof=1), 1e-8) if len(v) >= 10 else np.nan)
        g["rsi_14"], g["z_price"] = rsi, z
        out.append(g)
    return pd.concat(out)


def test_price_features(bars, bars_pdf):
    got = features.add_price_features(bars, spec=SMALL).toPandas()
    want = expected(bars_pdf)
    key = ["ticker", "timestamp"]
    both = want.merge(got, on=key, suffixes=("_w", ""))
    assert len(both) == len(bars_pdf)
    for c in ("log_return", "realized_vol", "momentum_20", "adv", "rsi_14", "z_price"):
        np.testing.assert_allclose(both[c].to_numpy(float), both[f"{c}_w"].to_numpy(float), rtol=1e-7, atol=1e-9)
    ratio = both["log_return_w"] / both["realized_vol_w"]
    np.testing.assert_allclose(both["vol_norm_return"].to_numpy(float), ratio.to_numpy(float), rtol=1e-7)


def test_missing_volatility_stays_missing(bars):
    rows = features.add_return_features(bars, spec=SMALL)
    assert rows.where("realized_vol is null and vol_norm_return is not null").count() == 0


def test_matrix_drops_warm_up_and_is_neutral_without_news(bars):
    m = features.build_feature_matrix(bars, spec=SMALL)
    assert m.where("realized_vol is null or momentum_60 is null").count() == 0
    row = m.agg(F.sum("weighted_sentiment"), F.sum("sentiment_count"), F.sum("regime"), F.count("*")).first()
    assert row[0] == row[1] == row[2] == 0 and row[3] == (400 - 61) + (90 - 61)


def test_encode_ids(spark, bars):
    ids = {r["ticker"]: r["id"] for r in features.encode_ids(bars, "ticker", "id").collect()}
    assert ids == {"K0": 0, "K1": 1, "K2": 2}
    other = spark.createDataFrame([("K2",), ("zz",)], "ticker string")
    got = features.with_encoded(other, "ticker", "id", features.encode_ids(bars, "ticker", "id"))
    assert {r["ticker"]: r["id"] for r in got.collect()} == {"K2": 2, "zz": 0}


def test_sequences_strictly_before_and_padded(spark, bars, bars_pdf):
    events = bars_pdf[["ticker", "timestamp"]].rename(columns={"timestamp": "t0"})
    off = events.head(40).assign(t0=lambda d: d.t0 + pd.Timedelta("7min"))
    events = pd.concat([events, off], ignore_index=True)
    got = features.sequence_windows(
        spark.createDataFrame(events), bars, ["close", "volume"], 6, SeriesSpec(span_seconds=86_400, rows_per_block=8)
    ).toPandas()
    seen = 0
    for _, e in events.iterrows():
        past = bars_pdf[(bars_pdf.ticker == e.ticker) & (bars_pdf.timestamp < e.t0)].sort_values("timestamp")
        hit = got[(got.ticker == e.ticker) & (got.t0 == e.t0)]
        if len(past) < 3:
            assert hit.empty
            continue
        seen += 1
        last = past.tail(6)[["close", "volume"]].to_numpy()
        want = np.vstack([np.zeros((6 - len(last), 2)), last])
        np.testing.assert_allclose(np.array([list(x) for x in hit.sequence.iloc[0]]), want, rtol=1e-6)
    assert seen == len(got)


@pytest.mark.parametrize("rows_per_block", [20, 10**6])
def test_regime_inputs_equal_dense_pivot(bars, bars_pdf, rows_per_block):
    got = regime.cross_section_of_rolling(bars, "close", F.stddev_samp, "s", 12, 4, rows_per_block).toPandas()
    grid = bars_pdf.pivot_table(index="timestamp", columns="ticker", values="close")
    want = grid.rolling(12, min_periods=4).std().mean(axis=1)
    a = got.set_index("timestamp")["s"].sort_index()
    assert list(a.index) == list(want.index)
    np.testing.assert_allclose(a.to_numpy(float), want.to_numpy(float), rtol=1e-9)


def test_regimes_are_causal_and_ordered(spark):
    rng = np.random.default_rng(0)
    n = 420
    vol = np.repeat([0.5, 1.5, 4.0], n // 3) + rng.normal(0, 0.05, n)
    ts = pd.Timestamp("2024-01-01") + np.arange(n) * pd.Timedelta("1h")
    pdf = pd.DataFrame({"ticker": "A", "timestamp": ts, "realized_vol": vol, "log_return": rng.normal(0, vol)})
    labels = regime.regime_labels(spark.createDataFrame(pdf), window=5, min_count=2)
    out = labels.toPandas().sort_values("timestamp")
    assert len(out) == n and set(out.regime) <= {0, 1, 2}
    head = regime.regime_labels(spark.createDataFrame(pdf.head(300)), window=5, min_count=2, strict=True)
    assert (head.toPandas().sort_values("timestamp").regime.head(200) == 0).all()


def test_regimes_walk_forward_on_sufficient_statistics(spark):
    """The same walk in numpy: one E-step on each chunk with the parameters it was labelled by, added to all before."""
    rng = np.random.default_rng(1)
    n = 1000
    vol = np.abs(np.repeat([0.5, 1.5, 4.0, 1.0, 3.0], n // 5) + rng.normal(0, 0.2, n))
    ts = pd.Timestamp("2024-01-01") + np.arange(n) * pd.Timedelta("1h")
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "timestamp": ts, "realized_vol": vol, "log_return": rng.normal(0, vol)}))
    got = regime.regime_labels(df, window=5, min_count=2).toPandas().sort_values("timestamp").set_index("timestamp").regime
    inputs = global_position(regime.regime_inputs(df, 5, 2), "timestamp", ["timestamp"])
    rows = inputs.toPandas().sort_values("pos")
    x = rows[["mean_vol", "mean_corr_proxy"]].to_numpy()

    def shares(points, w, m, c):
        logs = [np.log(wk) - 0.5 * np.linalg.slogdet(ck)[1] - 0.5 * np.einsum("ij,jk,ik->i", points - mk, np.linalg.inv(ck), points - mk) for wk, mk, ck in zip(w, m, c, strict=True)]
        e = np.exp(np.array(logs).T - np.max(logs, axis=0)[:, None])
        return e / e.sum(axis=1, keepdims=True)

    def refit(r, points, m, c):
        total, m, c = r.sum(axis=0), list(m), list(c)
        for k in np.flatnonzero(total >= 2):
            m[k] = r[:, k] @ points / total[k]
            cov = np.einsum("i,ij,ik->jk", r[:, k], points - m[k], points - m[k]) / total[k]
            c[k] = cov + np.eye(2) * 1e-6 * np.trace(cov)
        return total / total.sum(), np.array(m), c

    first = regime.first_mixture(inputs.where("pos < 200"), 200, 3, 42)
    seen, m, c = shares(x[:200], first.weights, first.means, first.covs), first.means, first.covs
    hits = 0
    for start in range(200, len(x), 200):
        w, m, c = refit(seen, x[:start], m, c)
        r = shares(x[start : start + 200], w, m, c)
        want = np.argsort(np.argsort(m[:, 0]))[r.argmax(axis=1)]
        hits += (got[rows.timestamp.iloc[start : start + 200]].to_numpy() == want).sum()
        seen = np.vstack([seen, r])
    assert hits >= len(x) - 200 - 2  # ties of two densities may round either way


def test_bar_interval(spark, bars, bars_pdf):
    got = sentiment.bar_interval(bars, SMALL).first()["bar_seconds"]
    gaps = [g.sort_values().diff().dt.total_seconds().median() for _, g in bars_pdf.groupby("ticker")["timestamp"]]
    assert got == pytest.approx(np.median(gaps))
    single = spark.createDataFrame([("A", pd.Timestamp("2024-01-01").to_pydatetime())], "ticker string, timestamp timestamp")
    assert sentiment.bar_interval(single).first()["bar_seconds"] == 300.0


def test_sentiment_equals_brute_force(spark, bars, bars_pdf):
    rng = np.random.default_rng(9)
    n = 300
    at = (pd.Timestamp("2024-01-02") + pd.to_timedelta(rng.integers(0, 40 * 24 * 60, n), unit="min")).to_numpy()
    news = pd.DataFrame(
        {
            # two thirds of the stories hit one ticker in one hour
            "ticker": np.where(np.arange(n) < 200, "K0", rng.choice(["K0", "K1", "none"], n)),
            "article_public_ts": np.where(np.arange(n) < 200, at[0], at),
            "headline_sentiment": rng.uniform(-1, 1, n),
            "credibility": rng.uniform(0, 1, n),
        }
    )
    # exactly on both ends of the window of the first K1 bar
    first = bars_pdf[bars_pdf.ticker == "K1"].timestamp.min()
    edge = news.head(2).assign(
        ticker="K1", article_public_ts=[first - pd.Timedelta("45s"), first - pd.Timedelta("45s") - pd.Timedelta("12h")]
    )
    news = pd.concat([news, edge], ignore_index=True)
    got = sentiment.merge_sentiment(bars, spark.createDataFrame(news), bar_seconds=3600.0).toPandas()
    assert len(got) == len(bars_pdf)
    for r in got.itertuples():
        u = news.article_public_ts + pd.Timedelta("45s")
        age = (r.timestamp - u).dt.total_seconds()
        hit = news[(news.ticker == r.ticker) & (age >= 0) & (age <= 12 * 3600)]
        assert r.sentiment_count == len(hit)
        if len(hit):
            w = np.exp(-3 * age[hit.index] / (12 * 3600)) * hit.credibility
            assert r.weighted_sentiment == pytest.approx((w * hit.headline_sentiment).sum() / w.sum(), abs=1e-9)
            assert r.max_credibility == pytest.approx(hit.credibility.max())
        else:
            assert r.weighted_sentiment == 0 and r.max_credibility == 0


def test_sentiment_of_a_hot_bucket(spark):
    """Two thirds of the news, all at other moments, in one horizon of one ticker, and bars among them."""
    rng = np.random.default_rng(2)
    start, n = pd.Timestamp("2024-01-02"), 900
    at = np.where(np.arange(n) < 600, rng.integers(0, 7200, n), rng.integers(-40_000, 90_000, n))
    news = pd.DataFrame(
        {
            "ticker": np.where(np.arange(n) < 600, "K0", rng.choice(["K0", "K1"], n)),
            "article_public_ts": start + pd.to_timedelta(at, unit="s"),
            "headline_sentiment": rng.uniform(-1, 1, n),
            "credibility": rng.uniform(0, 1, n),
        }
    )
    bars = pd.DataFrame({"ticker": np.repeat(["K0", "K1"], 150), "timestamp": list(start + np.arange(150) * pd.Timedelta("97s")) * 2})
    for bar_seconds in (600.0, 0.0):
        merged = sentiment.merge_sentiment(spark.createDataFrame(bars), spark.createDataFrame(news), bar_seconds=bar_seconds)
        got = merged.toPandas()
        assert len(got) == len(bars)
        for r in got.itertuples():
            age = (r.timestamp - news.article_public_ts).dt.total_seconds() - 45
            hit = news[(news.ticker == r.ticker) & (age >= 0) & (age <= 12 * bar_seconds)]
            assert r.sentiment_count == len(hit)
            w = np.exp(-3 * age[hit.index] / max(12 * bar_seconds, 1)) * hit.credibility
            want = (w * hit.headline_sentiment).sum() / w.sum() if len(hit) else 0
            assert r.weighted_sentiment == pytest.approx(want, abs=1e-9)
            assert r.max_credibility == pytest.approx(hit.credibility.max() if len(hit) else 0)


def test_matrix_carries_the_regime_of_its_time(spark, bars):
    times = bars.select("timestamp").distinct()
    regimes = times.withColumn("regime", (F.hour("timestamp") % 3).cast("long")).where(F.hour("timestamp") != 5)
    got = features.build_feature_matrix(bars, regimes=regimes).select("timestamp", "regime").collect()
    assert got and all(r.regime == (0 if r.timestamp.hour == 5 else r.timestamp.hour % 3) for r in got)


def test_features_at_events_are_all_there_and_few_others(spark, bars):
    events = bars.where("volume > 400").select("ticker", F.col("timestamp").alias("t0"))
    some = features.add_price_features(bars, at=events)
    want = features.add_price_features(bars).where("volume > 400")
    assert want.exceptAll(some).count() == 0 and some.exceptAll(want).count() < 10


def test_sequence_windows_move_rows_once(spark, bars):
    """Windows are taken where rows and events stand in order: no join, which would move each feature row some thirty times."""
    events = bars.where("volume > 400").select("ticker", F.col("timestamp").alias("t0"))
    windows = features.sequence_windows(events, bars, ["close"], 6)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_only_the_features_asked_for(spark, bars):
    some = features.add_price_features(bars, only=["adv", "rsi_14", "vol_norm_return"])
    assert some.columns == ["ticker", "timestamp", "adv", "rsi_14", "vol_norm_return"]
    assert some.exceptAll(features.add_price_features(bars).select(some.columns)).count() == 0


def test_cross_section_rolls_over_the_rows_once(spark, bars):
    """What follows the rolling statistics reads their differences, stored, and not the rows again."""
    returns = features.add_return_features(bars, spec=SeriesSpec(span_seconds=86_400))
    mean = regime.cross_section_of_rolling(returns, "log_return", F.stddev_samp, "dev", 20, 5)
    plan = mean._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp" not in plan and "MapInArrow" not in plan
    assert mean.where("dev > 0").count() > 100
