"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {name: sec}, "sf": ...}. Each query is executed in full with the
no-op sink (no collect); a warm-up on sf0.001 is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fairness_metrics",            # one slice, order_audit
    "fairness_metrics_sliced",     # per month x 2 attributes
    "evaluate_predictions",        # performance + fairness, 2 models x 80 months
    "bias_type",                   # rules over 160 audit rows
    "proxy_corr_pearson",          # line_features, all features
    "proxy_corr_spearman",
    "reweigh",
    "split_stratified",
    "group_roc",
    "threshold_parity",
    "impute_numeric",
    "train_logistic",
    "monitor_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from fairaudit.session import build_session
    from fairaudit.plans.registry import QUERIES, load_all
    load_all()
    spark = build_session(app="fairaudit-bench")
    # warm-up (JIT, class loading), not timed
    QUERIES["fairness_metrics"](spark, "/root/testdata/sf0.001").collect()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
