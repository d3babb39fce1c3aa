"""Headline queries on one folder of tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all]

Each query is run once to warm up and three times for the median, from building
the plan to the last row, into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

from corpusqa.plans import derived, extended
from corpusqa.plans.queries import registry
from corpusqa.plans.session import local_session

HEADLINE = (
    "dup_blocks", "dup_locations", "dup_smells", "file_stats", "line_classes", "file_metrics",
    "comment_islands", "rule_hits", "gated_rules", "lexicon_refs", "wildcard_counts",
    "marker_totals", "naming_styles", "token_topk", "token_exact", "block_extents",
    "issues_per_file", "corpus_metrics", "maintainability", "corpus_score", "link_graph",
    "advisory_match",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = registry((*derived.REGISTERED, *extended.REGISTERED))
    names = list(queries) if "--all" in sys.argv else HEADLINE
    result: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(4):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        result[name] = round(statistics.median(times[1:]), 3)
        print(f"{name:24s} {result[name]:7.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of median warm query times", "value": round(sum(result.values()), 3),
        "unit": "sec", "queries": result, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "spark": spark.version,
        "java": spark.sparkContext._jvm.java.lang.System.getProperty("java.version"),
        "python": platform.python_version(),
    }))


if __name__ == "__main__":
    main()
