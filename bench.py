"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "coupon_features", "label_15d", "user_features", "merchant_features",
    "user_merchant_features", "user_coupon_features", "receipt_features", "receipt_gaps",
    "dataset1_features", "dataset2_features", "dataset3_features",
    "auc_per_coupon", "auc_pooled", "zscore", "score_summary", "submission_sorted",
]

#: Rounds over all queries, of which the median counts, and seconds that they may take together.
RUNS, MOST_SECONDS = 3, 360


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    # One pass over the log starts the session, the readers and the compiler.
    QUERIES["label_15d"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs: dict[str, list[float]] = {name: [] for name in HEADLINE}
    begun = time.perf_counter()
    for again in range(RUNS):
        if again and time.perf_counter() - begun > again * MOST_SECONDS / RUNS:
            break  # a slow machine does fewer rounds
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - start)
    times = {name: round(median(taken), 3) for name, taken in runs.items()}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "runs": len(runs[HEADLINE[0]]),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
