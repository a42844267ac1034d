"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Each query is fully executed (collected); one small warm-up query runs first
and is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pareto_abc", "abc_summary", "concentration", "period_growth_yoy", "overview_kpis", "discount_by_product",
    "region_channel", "top_contribution", "data_quality", "numeric_profile", "distribution_profile", "histogram",
    "benford_1d", "benford_summary_1d", "correlation_table", "correlation_spearman", "lagged_corr",
    "group_summary", "anova_oneway", "kruskal", "mann_whitney", "friedman", "linear_regression",
    "logistic_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from ledgerlens.plans.registry import all_queries
    from ledgerlens.plans.runtime import get_session

    spark = get_session(master=f"local[{cpus}]", partitions=max(cpus, 8))
    qs = all_queries()
    qs["period_agg"](spark, sf_dir).collect()          # warm-up, not counted
    timings = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).collect()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {"metric": "total_query_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
