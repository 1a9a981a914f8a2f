"""Triple barrier, weights and purged folds."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalbars.operators import cv, features, labels
from causalbars.plans.series import SeriesSpec

SMALL = SeriesSpec(span_seconds=86_400, rows_per_block=30)


def path(spark, closes, ticker="A"):
    ts = pd.Timestamp("2024-01-01") + np.arange(len(closes)) * pd.Timedelta("1h")
    return spark.createDataFrame(pd.DataFrame({"ticker": ticker, "timestamp": ts, "close": closes}))


@pytest.mark.parametrize("drift,kind,label", [(1.05, "upper", 1), (0.95, "lower", -1)])
def test_trends_touch_their_barrier(spark, drift, kind, label):
    df = path(spark, 100 * drift ** np.arange(50))
    event = df.orderBy("timestamp").limit(11).orderBy(F.desc("timestamp")).limit(1).selectExpr("ticker", "timestamp as t0")
    row = labels.barrier_labels(df, event, max_holding=10, spec=SMALL).first()
    assert (row.barrier_type, row.label) == (kind, label)


def brute(pdf, pt, sl, hold, spacing, window=20):
    out = {}
    for ticker, g in pdf.sort_values("timestamp").groupby("ticker"):
        px, ts = g.close.to_numpy(), g.timestamp.to_list()
        if len(px) < 10 + window:
            continue
        lr = np.diff(np.log(px), prepend=np.nan)
        for i in range(window, max(len(px) - hold - 1, window), spacing):
            past = lr[i - window : i]
            past = past[~np.isnan(past)]
            sigma = max(past.std(ddof=1), 1e-4)
            ahead = range(i + 1, min(i + hold, len(px) - 1) + 1)
            end = next((j for j in ahead if px[j] >= px[i] * (1 + pt * sigma) or px[j] <= px[i] * (1 - sl * sigma)), None)
            if end is None:
                end, kind = ahead[-1], "vertical"
            else:
                kind = "upper" if px[end] >= px[i] * (1 + pt * sigma) else "lower"
            ret = px[end] / px[i] - 1
            out[ticker, ts[i]] = (ts[end], kind, {"upper": 1, "lower": -1}.get(kind, int(np.sign(ret))), ret)
    return out


@pytest.mark.parametrize("hold,spacing", [(5, 1), (20, 7)])
def test_labels_equal_brute_force(bars, bars_pdf, hold, spacing):
    got = labels.barrier_labels(bars, None, 1.5, 1.0, hold, spacing=spacing, spec=SMALL).toPandas()
    want = brute(bars_pdf, 1.5, 1.0, hold, spacing)
    assert len(got) == len(want) > 20
    for r in got.itertuples():
        t1, kind, label, ret = want[r.ticker, r.t0]
        assert (r.t1, r.barrier_type, r.label) == (t1, kind, label)
        assert r.return_at_touch == pytest.approx(ret)
        assert r.raw_weight == pytest.approx(abs(ret) * (0.5 if kind == "vertical" else 1.0))


def test_long_holding_periods(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(
        {"ticker": "A", "timestamp": pd.Timestamp("2024-01-01") + np.arange(5000) * pd.Timedelta("1h"), "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 5000)))}
    )
    df = spark.createDataFrame(pdf)
    for barrier in (8.0, 30.0):
        got = labels.barrier_labels(df, None, barrier, barrier, 2000, spacing=37, spec=SMALL)
        want = brute(pdf, barrier, barrier, 2000, 37)
        rows = got.collect()
        assert len(rows) == len(want)
        for r in rows:
            t1, kind, label, ret = want[r.ticker, pd.Timestamp(r.t0)]
            assert (pd.Timestamp(r.t1), r.barrier_type, r.label) == (t1, kind, label)
        if barrier == 30.0:
            assert {r.barrier_type for r in rows} >= {"vertical", "upper"}
    assert "collect_list" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("spec", [SMALL, SeriesSpec()])
def test_short_holding_periods_take_one_pass_that_brings_features(spark, bars, monkeypatch, spec):
    """No bar is written or joined for a short period, and the features at t0 are those that a join would find."""
    monkeypatch.setattr(labels, "stage", lambda *a: pytest.fail("bars written"))
    names = ["close", *features.RETURN_FEATURES, *features.TECHNICAL_FEATURES]
    got = labels.barrier_labels(bars, None, 1.5, 1.0, 6, spacing=3, spec=spec, with_features=names)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert {"high", "low", "volume"}.isdisjoint(got.columns) and "sector" in got.columns
    plain = labels.barrier_labels(bars, None, 1.5, 1.0, 6, spacing=3, spec=spec)
    at = features.add_price_features(bars, spec=spec).select("ticker", F.col("timestamp").alias("t0"), *names)
    want = plain.drop(*names).join(at, ["ticker", "t0"], "left").select(*got.columns)
    order = ["ticker", "t0"]
    a, b = got.toPandas().sort_values(order, ignore_index=True), want.toPandas().sort_values(order, ignore_index=True)
    assert len(a) > 100
    pd.testing.assert_frame_equal(a, b, check_exact=True)


def test_periods_beyond_the_end_of_a_series(spark):
    """An event at one of the last bars, and one whose barriers are not touched, end with the series."""
    df = path(spark, [100.0, 100.1, 100.2, 100.3])
    ts = sorted(r.timestamp for r in df.collect())
    events = spark.createDataFrame([("A", t, 0.04) for t in ts], "ticker string, t0 timestamp, sigma double")
    for hold in (2, 16, 17):
        rows = {r.t0: r for r in labels.barrier_labels(df, events, max_holding=hold).collect()}
        assert [rows[t].t1 for t in ts] == [ts[min(i + hold, 3)] for i in range(4)]
        assert {r.barrier_type for r in rows.values()} == {"vertical"}


def test_own_sigma_and_unknown_times(spark):
    df = path(spark, [100.0, 101.0, 99.0, 110.0])
    ts = df.orderBy("timestamp").first().timestamp
    events = spark.createDataFrame(
        [("A", ts, 0.04), ("A", pd.Timestamp("2030-01-01").to_pydatetime(), 0.04)], "ticker string, t0 timestamp, sigma double"
    )
    rows = labels.barrier_labels(df, events, max_holding=20).collect()
    assert len(rows) == 1 and rows[0].barrier_type == "upper" and rows[0].sigma_t0 == 0.04
    assert rows[0].return_at_touch == pytest.approx(0.1)


@pytest.mark.parametrize("scope", ["market", "ticker"])
def test_uniqueness_equals_pairwise_count(spark, bars, scope):
    df = labels.barrier_labels(bars, None, 1.5, 1.0, 6, spacing=3, spec=SMALL)
    got = labels.with_uniqueness(df, scope).toPandas()
    for r in got.itertuples():
        hit = (got.t0 <= r.t1) & (got.t1 >= r.t0)
        if scope == "ticker":
            hit &= got.ticker == r.ticker
        assert r.uniqueness_weight == pytest.approx(1 / hit.sum())


def test_sample_weights_sum_to_one(bars):
    rows = labels.label_universe(bars, 1.5, 1.0, 6, spacing=3, spec=SMALL)
    assert rows.agg(F.sum("sample_weight")).first()[0] == pytest.approx(1.0)
    assert rows.select("ticker").distinct().count() == 2  # the three-row ticker is too short
    with pytest.raises(ValueError):
        labels.with_uniqueness(rows, "sector")


def intervals(spark, n=101, days=5):
    t0 = pd.date_range("2024-01-01", periods=n, freq="1D")
    return spark.createDataFrame(
        pd.DataFrame({"ticker": "A", "t0": t0, "t1": t0 + pd.Timedelta(days=days), "y": np.arange(n, dtype=float)})
    )


@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_folds(spark, mode):
    n, k, days = 101, 4, 5
    got = cv.purged_folds(intervals(spark, n, days), k, 0.03, mode).toPandas()
    assert len(got) == n * k
    sizes = [len(x) for x in np.array_split(np.arange(n), k)]
    for fold in range(k):
        part = got[got.fold == fold].sort_values("pos")
        test = part[part.role == "test"].pos.to_numpy()
        assert len(test) == sizes[fold] and (np.diff(test) == 1).all()
        t1, t0 = part.t1.to_numpy(), part.t0.to_numpy()
        a, b = test[0], test[-1]
        keep = np.ones(n, bool)
        keep[a : b + 1 + int(np.ceil(0.03 * n))] = False
        if mode == "compat":
            keep[:a] &= (t1[:a] < t1[a - 1]) if a else True
        else:
            keep &= ~((t0 <= t1[b]) & (t1 >= t0[a]))
        assert (part[part.role == "train"].pos.to_numpy() == np.flatnonzero(keep)).all()


def test_strict_folds_do_not_leak_and_compat_can(spark):
    from causalbars.operators.guards import fold_overlaps

    rows = intervals(spark, 100, 30)
    strict = fold_overlaps(cv.purged_folds(rows, 5, 0.01)).agg(F.sum("violations")).first()[0]
    assert strict == 0
    uneven = rows.withColumn("t1", F.when(F.dayofmonth("t0") % 2 == 0, F.col("t0") + F.expr("interval 1 day")).otherwise(F.col("t1")))
    compat = fold_overlaps(cv.purged_folds(uneven, 5, 0.01, "compat")).agg(F.sum("violations")).first()[0]
    assert compat > 0


def test_fold_arguments(spark):
    with pytest.raises(ValueError):
        cv.PurgedFolds(1)
    with pytest.raises(ValueError):
        cv.PurgedFolds(3, 0.5)
    with pytest.raises(ValueError):
        cv.purged_folds(intervals(spark).drop("t1"))
    assert cv.PurgedFolds(3).get_n_splits() == 3


def test_whole_number_times(spark):
    df = spark.createDataFrame([("A", i, i + 5) for i in range(50)], "ticker string, t0 long, t1 long")
    sizes = cv.fold_sizes(cv.PurgedFolds(5, 0.0, "compat").split(df)).orderBy("fold").collect()
    assert [s.test_size for s in sizes] == [10] * 5
    assert [s.purged_count for s in sizes] == [0, 1, 1, 1, 1]


def test_evaluation_and_oof(spark):
    folds = cv.purged_folds(intervals(spark, 60), 3, 0.02)
    predicted = cv.evaluate_folds(folds, 3, cv.mean_model("y"))
    pdf = folds.toPandas()
    for r in predicted.select("fold", "prediction").distinct().collect():
        assert r.prediction == pytest.approx(pdf[(pdf.fold == r.fold) & (pdf.role == "train")].y.mean())
    error = F.avg(F.abs(F.col("y") - F.col("prediction")))
    per_fold = cv.fold_metrics(predicted, {"mae": error})
    summary = cv.metric_summary(per_fold, ["mae"]).first()
    values = [r.mae for r in per_fold.collect()]
    assert summary.mae_mean == pytest.approx(np.mean(values)) and summary.mae_std == pytest.approx(np.std(values))
    oof = cv.assemble_oof(intervals(spark, 60), predicted.where("fold > 0")).toPandas()
    assert (~oof.oof_mask).sum() == 20 and (oof[~oof.oof_mask].oof_prediction == 0).all()
    split = cv.calibration_split(folds, 3).groupBy("part").count().toPandas().set_index("part")["count"]
    assert split["test"] == split["calibration"] == 20


def test_folds_are_fitted_side_by_side_on_their_own_rows(spark):
    folds = cv.stored_by_fold(cv.purged_folds(intervals(spark), 4, 0.02))
    plan = cv.train_rows(folds, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    spans = {}

    def fit(k):
        began = time.time()
        total = cv.train_rows(folds, k).agg(F.sum("y")).first()[0]
        time.sleep(1)
        spans[k] = began, time.time()
        return k, total

    side_by_side, one_by_one = cv.fit_folds(fit, 4), cv.fit_folds(fit, 4, parallel=1)
    assert side_by_side == one_by_one and [k for k, _ in side_by_side] == [0, 1, 2, 3]
    cv.fit_folds(fit, 4)
    assert max(b for b, _ in spans.values()) < min(e for _, e in spans.values())


def test_fold_results_hold_sizes_and_metrics(spark):
    folds = cv.purged_folds(intervals(spark), 4, 0.02)
    predicted = cv.evaluate_folds(folds, 4, cv.mean_model("y"))
    per_fold = cv.fold_metrics(predicted, {"mse": F.avg((F.col("y") - F.col("prediction")) ** 2)})
    rows = cv.fold_results(folds, per_fold, ["mse"]).collect()
    assert len(rows) == 4 and all(r.train_size + r.test_size + r.purged_count == 101 and r.metrics["mse"] > 0 for r in rows)
