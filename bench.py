"""Time the headline queries; print one JSON line.

The queries run in turn, once to warm up and then RUNS times, each from its input
files to its last row (`noop` sink); the median counts. Loading the release
calendar is part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from ticklens.registered.queries import all_queries
from ticklens.session import build_session

HEADLINE = [
    "reaction_wide",
    "reaction_wide_chained",
    "price_summary_wide",
    "reaction_60m",
    "tick_parse",
    "tick_release_join",
    "gap_parse",
    "write_ticks_partitioned",
    "incremental_reaction",
]
RUNS = 5


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for _ in range(RUNS + 1):
        for name in HEADLINE:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - start)
    medians = {name: round(statistics.median(runs[1:]), 3) for name, runs in times.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "median seconds of the headline queries, summed",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
