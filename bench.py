"""Time the headline queries and print one JSON line.

Each query is built and run ``BENCH_RUNS`` times (default 3) into a sink that
takes every row and column; the median counts, plan building included.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.registry import all_queries
from pixledger.session import get_session

HEADLINE = [
    "A5_folder_table",
    "O4_pages",
    "W1_neighbours_big_folders",
    "O3_sort_by_date",
    "D1_parse_a1111",
    "D2_parse_comfy",
    "D5_parse_swarm",
    "D6_resolve_metadata",
    "S3_extract_tags",
    "J5_unparsed",
    "L2_param_facets",
    "L4_subtree_counts",
    "E2_folder_overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        f"local[{cpus}]",
        int(cpus),
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            found[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "rows": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
