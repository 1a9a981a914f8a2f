"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from causalbars.catalog.queries import QUERIES  # noqa: E402
from causalbars.session import local_session  # noqa: E402

HEADLINE = (
    "bars_daily",
    "feat_log_return",
    "feature_matrix",
    "triple_barrier",
    "label_uniqueness",
    "label_universe",
    "cv_purged_strict",
    "sentiment_merge",
    "guard_news_latency",
    "asof_entry",
    "asof_exit",
    "sequence_windows",
    "regime_inputs",
    "conformal_fit",
    "position_sizes",
    "backtest_trades",
    "performance_summary",
    "pbo",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cores, 8 if cores == "*" else int(cores))
    spark.range(1000).groupBy().sum().collect()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
