"""Headline queries on the driver tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from threadloom.plans import registry
from threadloom.session import local_session

HEADLINE = [
    "ext1", "ext10", "ext12", "ext17", "fmt1", "src3", "rel11", "rel13", "res4", "res8", "res9", "view5", "view10", "view20",
    "edit2", "edit4", "aud2", "aud4", "snk2", "gr2", "gr6", "gr7", "gr8", "str1", "rel8",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "20g"), "bench")
    run = registry.spark_queries()
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)

    def drain(frame):
        frame.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        timed(name, lambda: drain(run[name](spark, root)))
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": root.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
