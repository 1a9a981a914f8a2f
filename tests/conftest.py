"""Shared session and small random series."""

from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from causalbars.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "3g")
    yield session
    session.stop()


def random_bars(seed: int = 1, sizes: tuple[int, ...] = (400, 90, 3), step: str = "1h") -> pd.DataFrame:
    """Bars of unequal length with gaps; the first ticker holds most rows."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, n in enumerate(sizes):
        slots = np.sort(rng.choice(n * 3, size=n, replace=False))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        parts.append(
            pd.DataFrame(
                {
                    "ticker": f"K{i}",
                    "timestamp": pd.Timestamp("2024-01-01") + slots * pd.Timedelta(step),
                    "open": close * rng.uniform(0.99, 1.01, n),
                    "high": close * rng.uniform(1.01, 1.03, n),
                    "low": close * rng.uniform(0.97, 0.99, n),
                    "close": close,
                    "volume": rng.integers(1, 500, n).astype(float),
                    "sector": f"S{i % 2}",
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars_pdf():
    return random_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return spark.createDataFrame(bars_pdf).repartition(4).cache()
