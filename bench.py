"""Times the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One pass over all queries warms the session, then BENCH_RUNS (3) passes are timed; the
median per query counts. A result is written to the noop sink, so that every row and
column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from martwright.plans import REGISTRY
from martwright.session import build_session, temporary_tables


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or sorted(REGISTRY)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.log.level": "OFF",
        },
    )
    taken: dict[str, list[float]] = {name: [] for name in names}
    for _ in range(runs + 1):
        for name in names:
            with temporary_tables(spark):
                start = time.perf_counter()
                REGISTRY[name].build(spark, root).write.format("noop").mode("overwrite").save()
                taken[name].append(time.perf_counter() - start)
    timings = {name: round(statistics.median(t[1:]), 4) for name, t in taken.items()}
    print(
        json.dumps(
            {
                "metric": "sum of median warm query seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
