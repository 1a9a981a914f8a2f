"""Conformal bands, meta-labels, sizing, backtests and evaluation statistics."""

import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalbars.operators import backtest, conformal, meta, models, sizing, stats
from causalbars.plans.series import SeriesSpec


def bands(spark, n, seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    p50 = y + rng.normal(0, 0.3, n)
    return pd.DataFrame({"y": y, "p10": p50 - 0.25, "p50": p50, "p90": p50 + 0.25, "g": np.arange(n) % 2})


def test_conformal_band(spark):
    cal, test = bands(spark, 500, 1), bands(spark, 300, 2)
    band = conformal.ConformalBand(0.10)
    q = band.fit(spark.createDataFrame(cal), "y").first()
    score = np.maximum(cal.p10 - cal.y, cal.y - cal.p90)
    want = max(0.0, np.quantile(score, min(1.0, math.ceil(0.9 * 501) / 500)))
    assert q.n == 500 and q.q_hat == pytest.approx(want)
    out = band.transform(spark.createDataFrame(test))
    cover = conformal.coverage(out, "y").first()
    assert cover.adj_coverage >= 0.85 >= cover.raw_coverage
    row = out.first()
    assert row.band_width == pytest.approx(0.5 + 2 * want)
    grouped = conformal.ConformalBand(0.2, ["g"]).fit(spark.createDataFrame(cal), "y").collect()
    for r in grouped:
        s = score[cal.g == r.g]
        assert r.q_hat == pytest.approx(max(0, np.quantile(s, min(1, math.ceil(0.8 * (len(s) + 1)) / len(s)))))


def test_conformal_errors(spark):
    with pytest.raises(ValueError):
        conformal.ConformalBand(1.0)
    with pytest.raises(RuntimeError):
        conformal.ConformalBand().transform(spark.range(1))


def test_wide_bands_are_never_narrowed(spark):
    cal = bands(spark, 100, 3).assign(p10=-9.0, p90=9.0)
    out = conformal.ConformalBand().fit_transform(spark.createDataFrame(cal), "y", spark.createDataFrame(cal))
    assert out.where("p10_adj <> p10").count() == 0


def events(n=40):
    t0 = pd.date_range("2024-01-01", periods=n, freq="1D")
    rng = np.random.default_rng(4)
    return pd.DataFrame(
        {
            "ticker": "A",
            "t0": t0,
            "t1": t0 + pd.Timedelta(days=3),
            "p50": rng.choice([-0.01, 0.0, 0.01], n),
            "return_at_touch": rng.choice([-0.02, 0.0005, 0.02], n),
        }
    )


@pytest.mark.parametrize("resolved", [False, True])
def test_meta_labels(spark, resolved):
    pdf = events()
    spec = SeriesSpec(ts="t0", span_seconds=86_400, rows_per_block=6)
    got = meta.build_meta_labels(spark.createDataFrame(pdf), resolved_only=resolved, spec=spec).toPandas().sort_values("t0")
    want = ((np.sign(pdf.p50) == np.sign(pdf.return_at_touch)) & (pdf.return_at_touch.abs() > 0.0007)).astype(int)
    assert (got.meta_label.to_numpy() == want.to_numpy()).all() and (got.band_width == 1.0).all()
    for i in range(len(pdf)):
        past = [want[j] for j in range(max(0, i - 20), i) if not resolved or pdf.t1[j] <= pdf.t0[i]]
        assert got.recent_hit_rate.iloc[i] == pytest.approx(np.mean(past) if len(past) >= 5 else 0.5)


def test_binary_metrics(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"fold": np.arange(400) % 2, "meta_label": rng.integers(0, 2, 400), "proba": rng.integers(0, 21, 400) / 20})
    pdf.loc[pdf.fold == 1, "meta_label"] = 1
    got = {r.fold: r for r in meta.binary_metrics(spark.createDataFrame(pdf)).collect()}
    assert got[1].auc_roc is None
    a = pdf[pdf.fold == 0]
    pairs = [(p > q) + 0.5 * (p == q) for p in a[a.meta_label == 1].proba for q in a[a.meta_label == 0].proba]
    assert got[0].auc_roc == pytest.approx(np.mean(pairs))
    act = a.proba >= 0.5
    tp = (act & (a.meta_label == 1)).sum()
    assert got[0].precision == pytest.approx(tp / act.sum()) and got[0].recall == pytest.approx(tp / a.meta_label.sum())


def signal(spark, **over):
    row = {"p50": 0.05, "band_width": 1.0, "adv": 1e6, "realized_vol": 0.01, "meta_decision": 1, "close": 100.0, **over}
    return spark.createDataFrame(pd.DataFrame([row]))


def test_sizing(spark):
    sizer = sizing.PositionSizer()
    base = sizer.compute_sizes(signal(spark)).first()
    assert base.final_size_frac == pytest.approx(0.025) and base.direction == 1
    assert base.impact_cost_est == pytest.approx(0.1 * 0.01 * math.sqrt(0.025 / 1.0))
    assert sizer.compute_sizes(signal(spark, meta_decision=0)).first().final_size_frac == 0
    assert sizer.compute_sizes(signal(spark, p50=-0.05)).first().direction == -1
    assert sizer.compute_sizes(signal(spark, band_width=11.0)).first().final_size_frac == 0
    assert sizer.compute_sizes(signal(spark, adv=10.0, realized_vol=0.0)).first().final_size_frac == pytest.approx(1e-5)
    assert sizer.compute_sizes(signal(spark, adv=0.0)).first().final_size_frac == 0
    assert sizer.compute_sizes(signal(spark, adv=None)).first().final_size_frac == pytest.approx(0.025)
    twice, once = sizer, sizing.PositionSizer(cost_twice=False)
    edge = signal(spark, p50=0.0011, realized_vol=0.0)
    assert twice.compute_sizes(edge).first().final_size_frac == 0
    assert once.compute_sizes(edge).first().final_size_frac > 0
    bare = sizer.compute_sizes(signal(spark).drop("close", "realized_vol", "meta_decision")).first()
    assert bare.adv_size_limit == pytest.approx(0.01)
    s = sizing.sizing_summary(sizer.compute_sizes(signal(spark).union(signal(spark, meta_decision=0)))).first()
    assert (s.total_signals, s.acted, s.skipped, s.act_rate) == (2, 1, 1, 0.5)


def market(seed=0, days=60):
    rng = np.random.default_rng(seed)
    rows, signals = [], []
    for ticker in "ABC":
        ts = pd.Timestamp("2024-01-01") + np.arange(days * 4) * pd.Timedelta("6h")
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(ts))))
        rows.append(pd.DataFrame({"ticker": ticker, "timestamp": ts, "close": px}))
        for i in rng.choice(len(ts) - 30, 45, replace=False):
            t0 = ts[i] + (pd.Timedelta("1h") if i % 3 else pd.Timedelta(0))
            signals.append((ticker, t0, ts[i + rng.integers(1, 25)], rng.choice([-1, 1]), 0.01, rng.uniform(500, 3000)))
    columns = ["ticker", "t0", "t1", "direction", "return_at_touch", "final_size_dollars"]
    sig = pd.DataFrame(signals, columns=columns).drop_duplicates(["ticker", "t0"])
    sig["t1"] = np.maximum(sig.t1, sig.t0 + pd.Timedelta("1h"))
    sig["direction"] = sig.direction.astype(int)
    return pd.concat(rows), sig.assign(final_size_frac=sig.final_size_dollars / 1e4)


def simulate(bars, sig, capital, cap):
    """A day-by-day account, kept as plainly as possible."""
    book, log, curve = [], [], {}
    day, end = sig.t0.min().normalize(), sig.t1.max().normalize()
    todo = sig.sort_values(["t0", "ticker"])
    while day <= end:
        tomorrow = day + pd.Timedelta(days=1)
        for p in [p for p in book if p["t1"] <= tomorrow]:
            book.remove(p)
            past = bars[(bars.ticker == p["ticker"]) & (bars.timestamp <= p["t1"])]
            net = (past.close.iloc[-1] - p["px"]) * p["direction"] * p["usd"] / p["px"] - 0.0008 * p["usd"]
            capital += net
            log.append((p["ticker"], p["t0"], round(net, 6)))
        for s in todo[(todo.t0 >= day) & (todo.t0 < tomorrow)].itertuples():
            if len(book) >= cap or capital <= 0:
                break
            later = bars[(bars.ticker == s.ticker) & (bars.timestamp >= s.t0)]
            capital -= 0.0008 * s.final_size_dollars
            book.append({"ticker": s.ticker, "t0": s.t0, "t1": s.t1, "direction": s.direction, "px": later.close.iloc[0], "usd": s.final_size_dollars})
        curve[day.date()] = capital
        day = tomorrow
    return sorted(log), curve


@pytest.mark.parametrize("cap,capital", [(1000, 1e4), (3, 1e4), (1, 1e4), (8, 150.0)])
def test_backtest_equals_day_by_day_account(spark, cap, capital):
    bars, sig = market()
    spec = SeriesSpec(span_seconds=86_400, rows_per_block=11)
    run = backtest.run_backtest(
        spark.createDataFrame(sig.assign(strategy_id=7)), spark.createDataFrame(bars), capital, cap, spec=spec
    )
    log, curve = simulate(bars, sig, capital, cap)
    got = sorted((r.ticker, pd.Timestamp(r.t0), round(r.net_pnl, 6)) for r in run.trade_log().collect())
    assert got == log
    equity = {r.day: r.equity for r in run.equity_curve().collect()}
    assert equity.keys() == curve.keys()
    for d, v in curve.items():
        assert equity[d] == pytest.approx(v)
    s = run.summary().first()
    eq = pd.Series(curve).sort_index()
    r = eq.pct_change().dropna()
    assert s.n_trades == len(log)
    assert s.total_return == pytest.approx(eq.iloc[-1] / eq.iloc[0] - 1)
    assert s.max_drawdown == pytest.approx((eq / eq.cummax() - 1).min())
    assert s.sharpe_ratio == pytest.approx(r.mean() / r.std() * 252**0.5)
    assert s.sortino_ratio == pytest.approx(r.mean() / r[r < 0].std() * 252**0.5)


def test_caps_per_strategy(spark):
    bars, sig = market(1)
    both = pd.concat([sig.assign(strategy_id=i, cap=c) for i, c in ((0, 2), (1, 50))])
    run = backtest.run_backtest(spark.createDataFrame(both), spark.createDataFrame(bars), 1e4, "cap")
    counts = {r.strategy_id: r["count"] for r in run.admitted.groupBy("strategy_id").count().collect()}
    assert counts[0] < counts[1]


def test_no_trades_give_a_flat_curve(spark):
    bars, sig = market()
    idle = spark.createDataFrame(sig.assign(final_size_frac=0.0))
    run = backtest.run_backtest(idle, spark.createDataFrame(bars), 5e3)
    assert run.trade_log().count() == 0
    curve = run.equity_curve()
    assert curve.count() == 60 and curve.where("equity <> 5000").count() == 0
    s = run.summary().first()
    assert (s.sharpe_ratio, s.n_trades, s.total_return, s.max_drawdown) == (0.0, 0, 0.0, 0.0)


def test_trade_regimes(spark):
    trades = spark.createDataFrame(
        pd.DataFrame({"ticker": "A", "t0": pd.date_range("2024-01-01", periods=4), "net_pnl": [1.0, -1.0, 2.0, 3.0], "notional": [10.0, 10.0, 0.5, 10.0]})
    )
    known = trades.select("ticker", "t0").limit(3).withColumn("regime", F.lit(1))
    rows = {r.regime: r for r in backtest.regime_split(trades, known).collect()}
    assert rows[1].n_trades == 3 and rows[-1].n_trades == 1 and rows[-1].sharpe == 0.0
    assert rows[1].mean_ret == pytest.approx((0.1 - 0.1 + 2.0) / 3)
    assert stats.regime_breakdown(trades).first().regime == "unknown"


def returns(spark, x, sid=0):
    return spark.createDataFrame(pd.DataFrame({"strategy_id": sid, "ret": x}))


def test_deflated_sharpe(spark):
    x = np.random.default_rng(0).normal(0.001, 0.01, 500)
    one = stats.deflated_sharpe(returns(spark, x), 10).first()
    m, s = x.mean(), x.std(ddof=1)
    z = (x - m) / x.std()
    sr, skew, kurt = m / s, (z**3).mean(), (z**4).mean() - 3
    sd = math.sqrt((1 - skew * sr + (kurt + 1) * sr**2 / 4) / 499)
    n = NormalDist()
    top = (1 - 0.5772156649) * n.inv_cdf(0.9) + 0.5772156649 * n.inv_cdf(1 - 1 / (10 * math.e))
    assert one.psr == pytest.approx(n.cdf(sr / sd))
    assert one.dsr == pytest.approx(n.cdf((sr - top * sd) / sd))
    assert one.e_max_sr == pytest.approx(top * sd * 252**0.5)
    assert stats.deflated_sharpe(returns(spark, x), 100).first().dsr < one.dsr
    assert stats.deflated_sharpe(returns(spark, x), 1).first().dsr == 1.0
    few = stats.deflated_sharpe(returns(spark, x[:5]), 10).first()
    flat = stats.deflated_sharpe(returns(spark, np.zeros(50)), 10).first()
    assert (few.psr, few.dsr, flat.psr, flat.is_significant) == (0.0, 0.0, 0.5, False)
    dirty = stats.deflated_sharpe(returns(spark, np.append(x, [np.nan, np.inf])), 10).first()
    assert dirty.n_obs == 500


@pytest.mark.parametrize("t,n,s", [(203, 5, 4), (120, 4, 6)])
def test_overfitting_probability(spark, t, n, s):
    x = np.random.default_rng(6).normal(0, 0.01, (t, n))
    long = pd.DataFrame([(i, j, x[i, j]) for i in range(t) for j in range(n)], columns=["t", "strategy_id", "ret"])
    got = stats.overfitting_probability(spark.createDataFrame(long), s).first()
    size = t // s
    blocks = [x[i * size : (i + 1) * size] for i in range(s)]
    deltas = []
    for inside in itertools.combinations(range(s), s // 2):
        a = np.vstack([blocks[i] for i in inside])
        b = np.vstack([blocks[i] for i in range(s) if i not in inside])
        sa, sb = (v.mean(0) / v.std(0, ddof=1) * 252**0.5 for v in (a, b))
        deltas.append(sb[sa.argmax()] - np.median(sb))
    assert got.n_combinations == len(deltas)
    assert got.pbo == pytest.approx(np.mean(np.array(deltas) < 0))
    assert got.median_oos_delta_sr == pytest.approx(np.median(deltas))


def test_too_short_a_matrix_gives_nulls(spark):
    short = pd.DataFrame([(i, j, 0.1 * i) for i in range(10) for j in range(2)], columns=["t", "strategy_id", "ret"])
    row = stats.overfitting_probability(spark.createDataFrame(short), 4).first()
    assert row.pbo is None and row.n_combinations == 0


def test_model_helpers(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.2, 2.0), (0.5, 0.2, 0.3, 0.9, 1.0)], "p10 double, p50 double, p90 double, y double, w double")
    assert models.quantile_crossing(df).first().crossings == 1
    loss = models.pinball_loss(df, "y", "w").first()
    assert loss.loss_p50 == pytest.approx(np.mean([0.0, 0.35]))
    train = spark.createDataFrame([("a", float(i)) for i in range(30)] + [("b", 100.0)], "c string, y double")
    test = spark.createDataFrame([("a",), ("b",)], "c string")
    got = {r.c: r for r in models.quantile_forecast(train, test, "y", [["c"], []]).collect()}
    assert got["a"].p50 == pytest.approx(14.5) and got["b"].p50 == pytest.approx(15.0)


def test_a_forest_is_asked_once_for_a_row(spark):
    """Its probabilities stand outside any lambda, which would compute them again for each class."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=60), "_y": (np.arange(60) % 2).astype(float)})
    model = models.BaselineClassifier(["x"], n_trees=2)
    rows = model._assemble(spark.createDataFrame(pdf).repartition(2))
    forest = models.RandomForestClassifier(featuresCol="_features", labelCol="_y", probabilityCol="_proba", predictionCol="_pred", rawPredictionCol="_raw", numTrees=2)
    out = model._score(forest.fit(rows), rows).select("proba")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {len(r.proba) for r in out.collect()} == {3} and {r.proba[2] for r in out.collect()} == {0.0}


def test_classifiers_cover_every_row(spark):
    from causalbars.operators import cv
    from causalbars.plans.staging import stage

    rng = np.random.default_rng(8)
    n = 240
    t0 = pd.date_range("2024-01-01", periods=n, freq="1D")
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"ticker": "A", "t0": t0, "t1": t0 + pd.Timedelta(days=2), "x": x, "label": np.sign(np.round(x)).astype(int), "meta_label": (x > 0).astype(int), "sample_weight": 1.0 / n})
    folds = stage(cv.purged_folds(spark.createDataFrame(pdf), 2), "folds")
    base = models.BaselineClassifier(["x"], n_trees=5)
    oof = base.fit(folds, 2)
    assert oof.count() == n
    score = models.multiclass_metrics(oof).agg(F.avg("accuracy")).first()[0]
    assert score > 0.9
    assert base.feature_importance(oof).first().feature == "x"
    assert base.predict(spark.createDataFrame(pdf)).where("prediction = label").count() > 0.9 * n
    act = meta.MetaClassifier(["x"], n_trees=5)
    assert act.fit(folds, 2).where("prediction = meta_label").count() > 0.9 * n
    assert act.predict(spark.createDataFrame(pdf)).where("meta_decision = meta_label").count() > 0.9 * n


def _returns(spark, rows):
    return spark.createDataFrame(rows, "strategy_id string, t int, ret double")


def test_overfitting_on_unequal_calendars(spark):
    """A strategy without returns in whole blocks has a Sharpe ratio of 0 there, and nothing divides by zero."""
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.normal(0.01, 1))) for s in "abc" for t in range(80) if s != "c" or t < 20]
    table = np.full((80, 3), np.nan)
    for s, t, r in rows:
        table[t, "abc".index(s)] = r
    rows += [("a", 80, float("nan")), ("b", 80, None)]
    got = stats.overfitting_probability(_returns(spark, rows), 4).collect()[0]

    def sharpe(x):
        x = x[~np.isnan(x)]
        return x.mean() / x.std(ddof=1) * np.sqrt(252) if len(x) >= 2 else 0.0

    deltas = []
    for mask in range(16):
        if bin(mask).count("1") == 2:
            inside = np.repeat([mask >> b & 1 for b in range(4)], 20).astype(bool)
            ins, out = ([sharpe(table[m, k]) for k in range(3)] for m in (inside, ~inside))
            deltas.append(out[int(np.argmax(ins))] - np.median(out))
    assert got.n_combinations == 6
    assert got.pbo == pytest.approx(np.mean(np.array(deltas) < 0))
    assert got.median_oos_delta_sr == pytest.approx(np.median(deltas))


def test_one_strategy_has_no_overfitting_section(spark):
    one = _returns(spark, [("a", t, 0.01 * (t % 5)) for t in range(80)])
    got = stats.overfitting_probability(one, 4).collect()[0]
    assert got.n_combinations == 0 and got.pbo is None and got.is_overfit is None


def test_a_strategy_without_finite_returns_stays(spark):
    rows = [("a", t, 0.01 * (t % 5)) for t in range(80)] + [("b", t, float("nan")) for t in range(5)]
    moments = {r.strategy_id: r.n_obs for r in stats.sharpe_moments(_returns(spark, rows)).collect()}
    assert moments == {"a": 80, "b": 0}
    row = {r.strategy_id: r for r in stats.deflated_sharpe(_returns(spark, rows), 10).collect()}["b"]
    assert (row.sr, row.psr, row.dsr, row.is_significant) == (0.0, 0.0, 0.0, False)


def test_equal_signals_count_one_by_one(spark):
    """Two signals of one ticker and time when only one place is left."""
    day = dt.datetime(2024, 1, 1, 10)
    rows = [("A", day, day + dt.timedelta(days=5))] + [("B", day + dt.timedelta(days=1), day + dt.timedelta(days=6))] * 2
    trades = spark.createDataFrame(
        [(0, *r, 10.0, -1.0, 2.0) for r in rows],
        "strategy_id int, ticker string, t0 timestamp, t1 timestamp, entry_price double, entry_cost double, net_pnl double",
    )
    admitted = backtest.admit_signals(trades, 1000.0, 2)
    assert sorted(r.ticker for r in admitted.collect()) == ["A", "B"]
    assert backtest.admit_signals(trades, 1000.0, 5000).count() == 3


def test_only_days_from_the_first_refusal_on_are_walked_through(spark, monkeypatch):
    """Capital that runs out late under an unlimited cap, and comes back when later positions close."""
    rng = np.random.default_rng(12)
    first = dt.datetime(2024, 1, 1, 10)
    rows = []
    for d in range(120):
        for k in range(3):
            net = -400.0 if (d, k) == (80, 0) else 500.0 if (d, k) == (81, 0) else float(rng.normal(0, 1))
            ends = d + (20 if (d, k) == (81, 0) else int(rng.integers(1, 9)))
            rows.append((0, f"T{k}", first + dt.timedelta(days=d), first + dt.timedelta(days=ends), 10.0, -0.1, net))
    schema = "strategy_id int, ticker string, t0 timestamp, t1 timestamp, entry_price double, entry_cost double, net_pnl double"
    capital, book, want = 300.0, [], []
    for d in range(120):
        today = first + dt.timedelta(days=d)
        capital += sum(r[6] for r in book if r[3] <= today)
        book = [r for r in book if r[3] > today]
        for r in (r for r in rows if r[2] == today):
            if capital <= 0:
                break
            capital += r[5]
            book.append(r)
            want.append((r[2], r[1]))
    assert 250 < len(want) < 350
    stored = {}
    keep = backtest.stage
    monkeypatch.setattr(backtest, "stage", lambda df, name: stored.setdefault(name, keep(df, name)))
    got = backtest.admit_signals(spark.createDataFrame(rows, schema).repartition(4), 300.0, 1_000_000)
    assert sorted((r.t0, r.ticker) for r in got.collect()) == sorted(want)
    assert 0 < stored["bound"].count() < 150


def test_events_that_begin_and_end_at_bars_are_priced_without_asof_joins(spark, bars, bars_pdf, monkeypatch):
    """Events at bar times need one look at the bars; others, mixed with them, are priced as the as-of joins do alone."""
    small = SeriesSpec(span_seconds=86_400, rows_per_block=30)
    rows = []
    for ticker, g in bars_pdf.groupby("ticker"):
        ts = sorted(g.timestamp)
        rows += [(ticker, a.to_pydatetime(), b.to_pydatetime(), 0.01) for a, b in zip(ts[:-2:3], ts[2::3], strict=False)]
    schema = "ticker string, t0 timestamp, t1 timestamp, return_at_touch double"
    met = spark.createDataFrame(rows, schema)
    odd = [(t, a + dt.timedelta(minutes=m), b + dt.timedelta(minutes=n), r) for (t, a, b, r), m, n in zip(rows, itertools.cycle((0, 7, 0)), itertools.cycle((0, 7)))]
    odd += [("K0", dt.datetime(2090, 1, 1), dt.datetime(2090, 2, 1), 0.5), ("none", *rows[0][1:]), ("K0", dt.datetime(1990, 1, 1), dt.datetime(1990, 2, 1), 0.5)]
    odd += [("K0", None, rows[0][2], 0.5), ("K0", rows[0][1], None, 0.5)]
    mixed = spark.createDataFrame(odd, schema)
    order = ["ticker", "t0", "t1", "return_at_touch"]

    def plain(signals):
        entered = backtest.with_entry_price(signals, bars, small)
        return backtest.with_exit_price(entered, bars, small).toPandas().sort_values(order, ignore_index=True)

    want = plain(met), plain(mixed)
    got = backtest.price_signals(mixed, bars, small).toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(got[want[1].columns], want[1], check_exact=True)
    monkeypatch.setattr(backtest, "asof_join", lambda *a, **k: pytest.fail("as-of join"))
    got = backtest.price_signals(met, bars, small).toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(got[want[0].columns], want[0], check_exact=True)
