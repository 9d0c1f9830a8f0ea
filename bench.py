"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Written stages are built under the key ``stages`` first, so that each query's own time is visible;
the total includes them. Results are drained through a no-op sink, which computes every column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from choicemill.plans import routers, sourcing
from choicemill.queries import QUERIES
from choicemill.session import build_session

HEADLINE = [
    "observations", "query_splits_scaled", "utility_table", "cost_parameters", "fixed_policies",
    "best_fixed_policy", "category_policy_test", "graded_answers", "completeness_summary",
    "cost_distribution_scaled", "text_features", "bootstrap_weights", "member_predictions", "lambda_sweep",
    "test_decisions", "test_results", "model_signals", "routing_signals", "routing_signals_scaled",
    "paired_tests_bucketed", "changed_decisions", "group_comparison", "error_by_model_category",
    "ranking_errors", "pairwise_reversals", "ranking_by_margin", "policy_comparison", "stream_scorecard",
    "stream_decisions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(master=f"local[{cpus}]", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    times: dict[str, float] = {}

    start = time.time()
    sourcing.stage_core(spark, sf_dir)
    for group in (routers.FULL, routers.ABLATION):
        routers.stage_decisions(spark, sf_dir, group)
    times["stages"] = round(time.time() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
