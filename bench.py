"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (runs per query; the
median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.session import local_session  # noqa: E402
from pagemill.workloads.queries import QUERIES  # noqa: E402

HEADLINE = (
    "url_key",
    "dedup_pages",
    "extract_links",
    "link_edges",
    "detect_framework",
    "html_tokens",
    "remove_regions",
    "pages_to_markdown",
    "clean_footer",
    "blocked_reason",
    "choose_response",
    "crawl_bfs",
    "sitemap_expand",
    "numbered_paths",
    "crawl_sitemap",
    "markdown_sink",
    "full_run",
    "run_files",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
