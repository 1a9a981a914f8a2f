"""Data contracts: one aggregation per table, one row per rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table broke its contract."""


@dataclass(frozen=True)
class Contract:
    """Required columns with their types, and rules that hold for every row.

    A rule is a column that is true for a *bad* row.
    """

    name: str
    types: dict[str, tuple[type[T.DataType], ...]]
    required: tuple[str, ...]
    rules: dict[str, Column] = field(default_factory=dict)

    def bad_rows(self) -> dict[str, Column]:
        nulls = {f"{c} is null": F.col(c).isNull() for c in self.required}
        return {**nulls, **self.rules}


_TIME = (T.TimestampType,)
_TEXT = (T.StringType,)
_REAL = (T.DoubleType, T.FloatType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _outside(c: str, lo: float, hi: float) -> Column:
    return (F.col(c) < lo) | (F.col(c) > hi) | F.isnan(F.col(c).cast("double"))


def market_contract() -> Contract:
    prices = ("open", "high", "low", "close")
    types = {"timestamp": _TIME, "ticker": _TEXT, **{p: _REAL for p in prices}, "volume": _REAL}
    rules = {f"{p} must be positive": ~(F.col(p) > 0) for p in prices}
    rules["volume must not be negative"] = ~(F.col("volume") >= 0)
    rules["high must be >= low"] = F.col("high") < F.col("low")
    rules["high must be >= close"] = F.col("high") < F.col("close")
    return Contract("market", types, tuple(types), rules)


def news_contract() -> Contract:
    types = {
        "ticker": _TEXT,
        "article_public_ts": _TIME,
        "usable_after_ts": _TIME,
        "headline_sentiment": _REAL,
        "credibility": _REAL,
    }
    rules = {
        "headline_sentiment must be in [-1, 1]": _outside("headline_sentiment", -1, 1),
        "credibility must be in [0, 1]": _outside("credibility", 0, 1),
        "usable_after_ts must be after article_public_ts": F.col("usable_after_ts") <= F.col("article_public_ts"),
    }
    return Contract("news", types, tuple(types), rules)


def feature_contract() -> Contract:
    nullable = ("log_return", "realized_vol", "vol_norm_return", "momentum_5", "momentum_20", "momentum_60", "rsi_14")
    types = {
        "timestamp": _TIME,
        "ticker": _TEXT,
        "close": _REAL,
        **{c: _REAL for c in nullable},
        "regime": _WHOLE,
        "weighted_sentiment": _REAL,
    }
    rules = {
        "close must be positive": ~(F.col("close") > 0),
        "realized_vol must not be negative": F.col("realized_vol") < 0,
        "rsi_14 must be in [0, 100]": _outside("rsi_14", 0, 100),
        "regime must not be negative": F.col("regime") < 0,
        "weighted_sentiment must be in [-1, 1]": _outside("weighted_sentiment", -1, 1),
    }
    return Contract("features", types, tuple(c for c in types if c not in nullable), rules)


def label_contract() -> Contract:
    types = {
        "t0": _TIME,
        "t1": _TIME,
        "ticker": _TEXT,
        "label": _WHOLE,
        "return_at_touch": _REAL,
        "sample_weight": _REAL,
    }
    rules = {
        "label must be -1, 0 or 1": ~F.col("label").isin(-1, 0, 1),
        "sample_weight must be positive": ~(F.col("sample_weight") > 0),
        "t1 must be after t0": F.col("t1") <= F.col("t0"),
    }
    return Contract("labels", types, tuple(types), rules)


def check_schema(df: DataFrame, contract: Contract) -> list[str]:
    """Missing columns and wrong types; needs no data."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [f"missing column: {c}" for c in contract.types if c not in have]
    for c, allowed in contract.types.items():
        if c in have and not isinstance(have[c], allowed):
            problems.append(f"{c} has type {have[c].simpleString()}")
    return problems


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, violations) for every rule, from a single aggregation of the table."""
    missing = check_schema(df, contract)
    if missing:
        raise ContractError(f"{contract.name}: " + "; ".join(missing))
    bad = contract.bad_rows()
    counts = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, cond in enumerate(bad.values())])
    rows = [F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(bad)]
    return counts.select(F.inline(F.array(*rows)))


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """The table itself if it keeps the contract, else an error naming every broken rule."""
    broken = violations(df, contract).where(F.col("violations") > 0).collect()  # at most one row per rule
    if broken:
        raise ContractError(f"{contract.name}: " + "; ".join(f"{r['rule']} ({r['violations']} rows)" for r in broken))
    return df


def split_quarantine(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): every row lands in exactly one of the two."""
    is_bad = F.lit(False)
    for cond in contract.bad_rows().values():
        is_bad = is_bad | F.coalesce(cond, F.lit(False))
    return df.where(~is_bad), df.where(is_bad)
