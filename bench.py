"""Headline timings on one machine: prints one JSON line.

Every query starts from the given tables: nothing staged by an earlier query is reused.  When BENCH_SECONDS (default 1500)
are over, the queries that are left are named under "not_run" instead of being left out of the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from paymatch.plans import registry

QUERIES = (
    "c6_reconcile", "c11_route_invoice", "j4_resolve_vendor", "j7_candidates_exact_po", "j11_candidates_fuzzy_po",
    "l4_assign_lines_with_sequence_ratio", "v5_duplicate_counts", "three_way_match_report", "sequential_po_balance", "e5_append_ledger",
    "q4_run_stats", "j9_candidates_vendor", "j10_candidates_vendor_amount", "i8_canonicalize_batch", "j13_discover_candidates",
    "v17_validation_report", "m8_match_package", "m8_match_package_with_fuzzy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["q4_run_stats"](spark, sf_dir).count()  # start the workers
    only = sys.argv[1:] or QUERIES
    times, not_run, began = {}, [], time.perf_counter()
    for name in only:
        if time.perf_counter() - began > float(os.environ.get("BENCH_SECONDS", "1500")):
            not_run.append(name)
            continue
        registry.forget_fixtures()
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "not_run": not_run}))


if __name__ == "__main__":
    main()
