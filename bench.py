"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Plan building, intermediate writes and the full result are all part of a time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import QUERIES
from sitefold.session import build_session

HEADLINE = (
    "canonicalize_url", "classify_products", "stable_hash", "page_links", "elements",
    "jsonld_reviews", "html_reviews", "review_pages", "products", "dedupe_reviews",
    "dedupe_candidates", "stop_rules", "discover_search", "discover_sitemap", "link_bfs",
    "ingest_reviews", "catalog_export",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Each query runs once untimed on the smallest tables, which loads and compiles its classes.
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(small):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
