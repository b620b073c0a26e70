"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the cores. All queries run once to warm up, then each runs twice; the better time counts.
All result rows are produced (noop sink), none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadastrum.registry import QUERIES  # noqa: E402
from cadastrum.session import build_session  # noqa: E402

HEADLINE = [
    "sales_by_department",
    "sales_national",
    "sales_by_property_type",
    "sales_by_commune",
    "sales_silver",
    "quality_funnel",
    "csv_scan",
    "sales_trend",
    "quantiles",
    "weighted_median",
    "weighted_mean",
    "commune_year",
    "derived_departments",
    "income_year_summary",
    "availability",
    "income_trend",
    "measure_pivot",
    "first_per_key",
    "explorer_page",
    "filtered_count",
    "typed_filters",
    "text_repair",
    "fold_snake",
    "build_all_years",
]


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        timed(QUERIES[name], spark, sf_dir)
    for name in names:
        times[name] = round(min(timed(QUERIES[name], spark, sf_dir) for _ in range(2)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
