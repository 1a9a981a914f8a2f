"""Event-driven backtests for many strategies at once.

Prices, profit and loss, equity and all statistics are relational.  Only the
admission of signals under a cap on open positions is a state machine; it runs
as a stream in the order of days, from the first day on that a relational
step cannot decide.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.functions.exprs import rate, so_far
from causalbars.llm.bits import bit_table
from causalbars.plans.series import DAILY, SeriesSpec, asof_join
from causalbars.plans.staging import stage

# Trading days per year, smallest meaningful deviation.
YEAR = 252
TINY = 1e-10

STRATEGY = "strategy_id"


def with_entry_price(signals: DataFrame, bars: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """``entry_price``: the first close at or after t0."""
    return asof_join(signals, bars, F.col("close"), "entry_price", "t0", direction="forward", spec=spec)


def with_exit_price(signals: DataFrame, bars: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """``exit_price``: the last close at or before t1, else the entry moved by the label's return."""
    return _with_exit_fallback(_last_close(signals, bars, spec))


def _last_close(signals: DataFrame, bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    return asof_join(signals, bars, F.col("close"), "exit_price", "t1", direction="backward", spec=spec)


def _with_exit_fallback(priced: DataFrame) -> DataFrame:
    return priced.withColumn(
        "exit_price", F.coalesce("exit_price", F.col("entry_price") * (1.0 + F.col("return_at_touch")))
    )


def price_signals(signals: DataFrame, bars: DataFrame, spec: SeriesSpec = DAILY) -> DataFrame:
    """Entry and exit price per distinct (ticker, t0, t1), joined back to the signals.

    A grid of strategies trades the same events; each event is priced once.  Most of them begin and end at a bar: one look at the bars
    finds these, and the as-of joins are left with the others and with the bars of their series.
    """
    key = [*spec.keys, "t0", "t1"]
    events = signals.select(*key).distinct().dropna(subset=key)
    met = stage(_met_closes(stage(events, "trade-times"), bars, spec), "met")
    entries, exits = "entry_price", "exit_price"
    late = met.where("_no_entry").drop(entries)
    if not late.isEmpty():
        late = with_entry_price(late, _series_of(late, bars, spec), spec)
        met = stage(met.where("not _no_entry").unionByName(late), "entered")
    early = met.where("_no_exit").drop(exits)
    if not early.isEmpty():
        early = _last_close(early, _series_of(early, bars, spec), spec)
        met = met.where("not _no_exit").unionByName(early)
    return _with_exit_fallback(signals.join(met.drop("_no_entry", "_no_exit"), key))


def _met_closes(events: DataFrame, bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``entry_price`` and ``exit_price`` of events (keys, t0, t1) from the bars at just these times; ``_no_entry``, ``_no_exit``: there is none."""
    keys = list(spec.keys)
    times = events.select(*keys, F.explode(F.array("t0", "t1")).alias(spec.ts))
    at = bars.select(*keys, spec.ts, "close").where(_asked(times, bars, [*keys, spec.ts]))
    # Of bars of one time any may be met.
    at = stage(at.groupBy(*keys, spec.ts).agg(F.max("close").alias("close")), "closes")
    for t, name, none in (("t0", "entry_price", "_no_entry"), ("t1", "exit_price", "_no_exit")):
        found = at.select(*keys, F.col(spec.ts).alias(t), F.col("close").alias(name), F.lit(False).alias(none))
        events = events.join(found, [*keys, t], "left").withColumn(none, F.coalesce(none, F.lit(True)))
    return events


def _series_of(events: DataFrame, bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The bars of the events' series, and few others."""
    return bars.where(_asked(events.select(*spec.keys), bars, list(spec.keys)))


def _asked(wanted: DataFrame, bars: DataFrame, columns: list[str]) -> Column:
    """True for bars whose ``columns`` are among ``wanted``, and for few others."""
    hashed = F.xxhash64(*[F.col(c).cast(bars.schema[c].dataType) for c in columns])
    return bit_table(wanted.select(hashed)).test()(F.xxhash64(*columns))


def with_trade_pnl(priced: DataFrame, spread_bps: float = 3.0, cost_bps: float = 5.0) -> DataFrame:
    """Shares, gross and net result of a trade.

    Exit costs belong to the trade; entry costs are charged to the capital when the
    position opens (``entry_cost``).
    """
    notional = F.col("final_size_dollars")
    cost = (spread_bps + cost_bps) / 10_000.0
    return (
        priced.withColumn("notional", notional)
        .withColumn("shares", notional / F.when(F.col("entry_price") > 0, F.col("entry_price")))
        .withColumn(
            "gross_pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("direction") * F.col("shares")
        )
        .withColumn("cost_pnl", -cost * F.abs("notional"))
        .withColumn("net_pnl", F.col("gross_pnl") + F.col("cost_pnl"))
        .withColumn("entry_cost", -cost * F.col("notional"))
    )


def with_trade_days(trades: DataFrame) -> DataFrame:
    """UTC day a position opens, and the day on which it is closed.

    Positions close before new ones open, and one that ends exactly at midnight
    closes on the day before; none closes on its opening day.
    """
    ends = F.to_date("t1")
    at_midnight = F.col("t1") == F.date_trunc("day", F.col("t1"))
    return trades.withColumn("open_day", F.to_date("t0")).withColumn(
        "close_day",
        F.greatest(F.date_add("open_day", 1), F.when(at_midnight, F.date_sub(ends, 1)).otherwise(ends)),
    )


def _admission(initial_capital: float):
    """Admission of rows that come by strategy, day and rank; see ``admit_signals``.

    The state is the open account of one strategy: capital, open positions, and one entry per day on which some will
    close.  Rows of rank 0 are the opening balance.
    """

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, today, capital, n_open = None, None, initial_capital, 0
        pending: dict = {}
        days: list = []

        def later(day, n: int, cash: float) -> None:
            if day not in pending:
                pending[day] = [0, 0.0]
                heapq.heappush(days, day)
            pending[day][0] += n
            pending[day][1] += cash

        for batch in batches:
            taken = []
            rows = zip(*[batch.column(c).to_pylist() for c in _NARROW], strict=True)
            for i, (strategy, day, rank, closes, n, cost, net, cap) in enumerate(rows):
                if strategy != sid:
                    sid, today, capital, n_open = strategy, None, initial_capital, 0
                    pending.clear(), days.clear()
                if rank == 0:
                    later(closes, n, net)
                    continue
                if day != today:
                    today = day
                    while days and days[0] <= today:
                        moved, cash = pending.pop(heapq.heappop(days))
                        n_open += moved
                        capital += cash
                if n_open >= cap or capital <= 0:
                    continue
                capital += cost
                n_open += 1
                later(closes, n, net)
                taken.append(i)
            yield batch.take(pa.array(taken, pa.int64())).select([STRATEGY, "open_day", "rank"])

    return admit


_NARROW = (STRATEGY, "open_day", "rank", "close_day", "n", "entry_cost", "net_pnl", "cap")


def admit_signals(
    trades: DataFrame, initial_capital: float, max_concurrent: int | str, ties: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Trades taken when at most ``max_concurrent`` positions may be open.

    ``max_concurrent`` is a number or the name of a per-strategy column.  Signals
    are offered in (t0, ties) order.  Days start by closing what has expired; a
    full book or capital used up ends a day's entries; signals without a usable
    price are passed over.  Up to the first day on which taking every trade would break
    cap or capital, nothing is refused: these days are decided from daily totals, all of them for
    most strategies.  The days from there on are walked through in order, as a stream that
    starts with the account of the days before, one row per day on which some of its positions close.
    No day can admit more than the cap, so only the first ``cap`` usable signals of each of these days
    are sent: they are found by a ranked limit (which Spark applies before
    the shuffle up to its own limit of 1,000).  Signals of one ticker and time count one by one.
    """
    cap = F.col(max_concurrent) if isinstance(max_concurrent, str) else F.lit(max_concurrent)
    usable = with_trade_days(trades).where(F.col("entry_price").isNotNull() & (F.col("entry_price") > 0))
    slack = stage(_first_bound(usable.withColumn("_cap", cap), initial_capital), "slack")
    placed = usable.join(slack, STRATEGY)
    free = placed.where(F.col("_from").isNull() | (F.col("open_day") < F.col("_from")))
    bound = placed.where(F.col("open_day") >= F.col("_from"))

    # One number: a constant bound is what lets Spark cut the ranking before the shuffle.
    largest = slack.where(F.col("_from").isNotNull()).agg(F.max("largest")).first()[0] or 0
    by_day = Window.partitionBy(STRATEGY, "open_day").orderBy("t0", *ties)
    bound = bound.withColumn("rank", F.row_number().over(by_day)).where(F.col("rank") <= F.lit(largest))
    # Stored: a signal is known by its day and rank, also where others have its ticker and time.
    bound = stage(bound.where(F.col("rank") <= cap), "bound")
    narrow = bound.select(
        STRATEGY,
        "open_day",
        "rank",
        "close_day",
        F.lit(-1).cast("long").alias("n"),
        F.coalesce("entry_cost", F.lit(0.0)).alias("entry_cost"),
        F.coalesce("net_pnl", F.lit(0.0)).alias("net_pnl"),
        cap.cast("long").alias("cap"),
    )
    opening = (
        free.where(F.col("_from").isNotNull())
        .select(STRATEGY, "_from", F.explode(_moves()).alias("m"))
        .groupBy(STRATEGY, F.col("_from").alias("open_day"), F.greatest("m.day", "_from").alias("close_day"))
        .agg(F.sum("m.n").cast("long").alias("n"), F.coalesce(F.sum("m.cash"), F.lit(0.0)).alias("net_pnl"))
        .withColumns({"rank": F.lit(0), "entry_cost": F.lit(0.0), "cap": F.lit(0).cast("long")})
    )
    in_order = narrow.unionByName(opening).repartition(STRATEGY).sortWithinPartitions(STRATEGY, "open_day", "rank").select(*_NARROW)
    schema = T.StructType([narrow.schema[c] for c in (STRATEGY, "open_day", "rank")])
    taken = in_order.mapInArrow(_admission(float(initial_capital)), schema)
    admitted = bound.join(taken, [STRATEGY, "open_day", "rank"], "left_semi")
    return free.drop("_from", "largest").unionByName(admitted.drop("rank", "_from", "largest"))


def _moves() -> Column:
    """What a trade does to the account when it opens and when it closes."""
    return F.array(
        F.struct(F.col("open_day").alias("day"), F.lit(1).alias("n"), F.col("entry_cost").alias("cash")),
        F.struct(F.col("close_day").alias("day"), F.lit(-1).alias("n"), F.col("net_pnl").alias("cash")),
    )


def _first_bound(trades: DataFrame, initial_capital: float) -> DataFrame:
    """Per strategy ``_from``: the first day that would end above the cap or without capital if every trade were taken.

    Before it no signal is refused, and where it is null none ever is, so the account need not be
    walked through.  Runs on one row per strategy and day.
    """
    days = (
        trades.select(STRATEGY, "_cap", F.explode(_moves()).alias("m"))
        .groupBy(STRATEGY, F.col("m.day").alias("day"))
        .agg(F.sum("m.n").alias("n"), F.sum("m.cash").alias("cash"), F.min("_cap").alias("_cap"))
    )
    by_day = so_far(Window.partitionBy(STRATEGY).orderBy("day"))
    held = F.coalesce((F.col("_open") <= F.col("_cap")) & (F.col("_capital") > 0), F.lit(False))
    return (
        days.withColumn("_open", F.sum("n").over(by_day))
        .withColumn("_capital", F.lit(float(initial_capital)) + F.coalesce(F.sum("cash").over(by_day), F.lit(0.0)))
        .groupBy(STRATEGY)
        .agg(F.min(F.when(~held, F.col("day"))).alias("_from"), F.max("_cap").cast("long").alias("largest"))
    )


def run_backtest(
    signals: DataFrame,
    bars: DataFrame,
    initial_capital: float = 1_000_000.0,
    max_concurrent: int | str = 20,
    spread_bps: float = 3.0,
    cost_bps: float = 5.0,
    spec: SeriesSpec = DAILY,
) -> "Backtest":
    """Backtest every ``strategy_id`` in ``signals`` (sized, with t0, t1, return_at_touch)."""
    if STRATEGY not in signals.columns:
        signals = signals.withColumn(STRATEGY, F.lit(0))
    # The calendar covers all signals that want a position, admitted or not.
    acted = signals.where(F.col("final_size_frac") > 0)
    priced = with_trade_pnl(price_signals(acted, bars, spec), spread_bps, cost_bps)
    admitted = stage(admit_signals(stage(priced, "priced"), initial_capital, max_concurrent), "admitted")
    return Backtest(signals, bars, admitted, initial_capital)


class Backtest:
    """Result tables of a backtest, all keyed by ``strategy_id``."""

    def __init__(self, signals: DataFrame, bars: DataFrame, admitted: DataFrame, initial_capital: float):
        self.signals, self.bars, self.admitted, self.initial_capital = signals, bars, admitted, initial_capital

    def calendar(self) -> DataFrame:
        """(strategy_id, first_day, last_day); the bars' days for a strategy without trades."""
        acts = F.col("final_size_frac") > 0
        spans = self.signals.groupBy(STRATEGY).agg(
            F.min(F.when(acts, F.to_date("t0"))).alias("_first"), F.max(F.when(acts, F.to_date("t1"))).alias("_last")
        )
        days = self.bars.agg(F.to_date(F.min("timestamp")).alias("a"), F.to_date(F.max("timestamp")).alias("b"))
        return spans.select(
            STRATEGY,
            F.coalesce("_first", days.select("a").scalar()).alias("first_day"),
            F.coalesce("_last", days.select("b").scalar()).alias("last_day"),
        )

    def trade_log(self) -> DataFrame:
        """Closed trades; a position whose closing day lies past the calendar never closes."""
        ends = self.calendar().select(STRATEGY, "last_day")
        return self.admitted.join(ends, STRATEGY).where(F.col("close_day") <= F.col("last_day")).drop("last_day")

    def equity_curve(self) -> DataFrame:
        """Realised capital at the end of each calendar day: (strategy_id, day, equity)."""
        calendar = self.calendar()
        flows = (
            self.admitted.select(
                STRATEGY,
                F.explode(
                    F.array(
                        F.struct(F.col("open_day").alias("day"), F.col("entry_cost").alias("cash")),
                        F.struct(F.col("close_day").alias("day"), F.col("net_pnl").alias("cash")),
                    )
                ).alias("f"),
            )
            .groupBy(STRATEGY, F.col("f.day").alias("day"))
            .agg(F.sum("f.cash").alias("cash"))
        )
        days = calendar.select(STRATEGY, F.explode(F.sequence("first_day", "last_day")).alias("day"))
        by_day = so_far(Window.partitionBy(STRATEGY).orderBy("day"))  # one row per day
        return days.join(flows, [STRATEGY, "day"], "left").select(
            STRATEGY,
            "day",
            (F.lit(float(self.initial_capital)) + F.sum(F.coalesce("cash", F.lit(0.0))).over(by_day)).alias("equity"),
        )

    def daily_returns(self) -> DataFrame:
        return daily_returns(self.equity_curve())

    def summary(self) -> DataFrame:
        return performance_summary(self.equity_curve(), self.trade_log())


def daily_returns(equity: DataFrame) -> DataFrame:
    """Relative change of equity from day to day, without the first day."""
    by_day = Window.partitionBy(STRATEGY).orderBy("day")  # one row per day
    before = F.lag("equity").over(by_day)
    return (
        equity.withColumn("_before", before)
        .where(F.col("_before").isNotNull())
        .select(STRATEGY, "day", (F.try_divide(F.col("equity"), F.col("_before")) - 1.0).alias("ret"))
        .where(F.col("ret").isNotNull())
    )


def _annual(mean: Column, deviation: Column, periods: int = YEAR) -> Column:
    return F.when(deviation >= TINY, mean / deviation * float(periods) ** 0.5).otherwise(0.0)


def performance_summary(equity: DataFrame, trades: DataFrame) -> DataFrame:
    """Sharpe, Sortino, Calmar, drawdown, win rate, trade count and total return per strategy."""
    by_day = so_far(Window.partitionBy(STRATEGY).orderBy("day"))
    curve = (
        equity.withColumn("_peak", F.max("equity").over(by_day))
        .withColumn("_dd", (F.col("equity") - F.col("_peak")) / F.greatest("_peak", F.lit(1e-8)))
        .groupBy(STRATEGY)
        .agg(
            F.min("_dd").alias("max_drawdown"),
            (F.max_by("equity", "day") / F.min_by("equity", "day") - 1.0).alias("total_return"),
        )
    )
    r = F.col("ret")
    returns = (
        daily_returns(equity)
        .groupBy(STRATEGY)
        .agg(
            F.avg(r).alias("_mean"),
            F.stddev_samp(r).alias("_std"),
            F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        )
    )
    won = trades.groupBy(STRATEGY).agg(
        F.count(F.lit(1)).alias("n_trades"), rate(F.col("net_pnl") > 0).alias("win_rate")
    )
    drawdown = F.abs("max_drawdown")
    mean = F.coalesce("_mean", F.lit(0.0))
    return (
        curve.join(returns, STRATEGY, "left")
        .join(won, STRATEGY, "left")
        .select(
            STRATEGY,
            _annual(mean, F.col("_std")).alias("sharpe_ratio"),
            F.when(F.col("_down") > TINY, _annual(mean, F.col("_down"))).otherwise(0.0).alias("sortino_ratio"),
            F.when(drawdown > TINY, mean * YEAR / drawdown).otherwise(0.0).alias("calmar_ratio"),
            "max_drawdown",
            "win_rate",
            F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
            "total_return",
        )
    )


def with_trade_regime(trades: DataFrame, labels: DataFrame | None = None, default: int = -1) -> DataFrame:
    """The trade's own regime, else its label's, else ``default``."""
    if "regime" in trades.columns:
        return trades
    if labels is None or "regime" not in labels.columns:
        return trades.withColumn("regime", F.lit(default))
    return trades.join(labels.select("ticker", "t0", "regime"), ["ticker", "t0"], "left").fillna(default, ["regime"])


def regime_split(trades: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Trades, win rate, mean return and Sharpe ratio per regime."""
    ret = F.col("net_pnl") / F.greatest(F.col("notional"), F.lit(1.0))
    return (
        with_trade_regime(trades, labels)
        .withColumn("_ret", ret)
        .groupBy("regime")
        .agg(
            F.count(F.lit(1)).alias("n_trades"),
            rate(F.col("net_pnl") > 0).alias("win_rate"),
            F.avg("_ret").alias("mean_ret"),
            F.stddev_samp("_ret").alias("_std"),
        )
        .withColumn("sharpe", F.when(F.col("_std") > TINY, F.col("mean_ret") / F.col("_std") * YEAR**0.5).otherwise(0.0))
        .drop("_std")
    )
