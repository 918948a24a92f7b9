"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name-prefix ...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "r17_upsert", "r26_bootstrap_listings", "r31_page_links", "r32_spec_sheets", "r35_harmonise_uk", "r37_clean_pool",
    "r39_nearest_spec", "r47_comps", "r48_comps_summary", "r57_health_score", "r58_cleaning_ledger", "r60_rate_curve",
    "r64_group_folds", "r73_repair_or_sell", "r78_numeric_summary", "r87_correlations", "r89_correlation_ratio",
    "r94_health_score", "r96_latest_snapshot", "r98_match_replies", "r101_negotiation", "r103_next_free_slot", "r62_forest",
]


def main() -> None:
    from motoquant.plans.registry import all_queries
    from motoquant.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores, "bench")
    queries = all_queries()
    wanted = [q for q in HEADLINE if not sys.argv[1:] or q.startswith(tuple(sys.argv[1:]))]

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("r36_pool")  # start-up and class loading are not part of any query
    times = {}
    for name in wanted:
        times[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cores,
    }))


if __name__ == "__main__":
    main()
