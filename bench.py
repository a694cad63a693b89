"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Every query is
run once to warm up and then timed; the best of three counts.
"""

import json
import os
import pathlib
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from registered import QUERIES  # noqa: E402
from siftwell import build_session  # noqa: E402
from siftwell.operators.outliers import outliers  # noqa: E402
from siftwell.operators.profile import profile  # noqa: E402
from siftwell.session import scratch_path  # noqa: E402
from siftwell.sources import csv, samples  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "slice_in", "slice_and_or_not", "page_2_of_sorted", "preview_head", "preview_sample", "pivot_flat_sum",
    "pivot_flat_count_distinct", "pivot_flat_median", "pivot_median_by_order", "pivot_wide_sum", "frequencies",
    "distinct_values_search", "summarize_lineitem", "profile_histogram", "exact_quantiles", "outliers_extremes",
    "outliers_duplicates_rows", "join_inner", "join_full", "join_three_way", "join_probe_orders_lineitem",
    "join_findings", "sql_window", "csv_roundtrip", "staleness", "dependents")


def timed(run, runs=RUNS):
    run()
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main():
    spark = build_session(f"local[{CPUS}]", app="bench", spark__sql__shuffle__partitions=CPUS,
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        times[name] = timed(lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    times["profile_lineitem"] = timed(lambda: profile(lineitem))
    times["outliers_lineitem"] = timed(lambda: outliers(lineitem))

    def sample():
        made = scratch_path(spark, "bench-sample")
        samples.generate_orders(spark, f"{made}/orders", 1_000_000)
        samples.generate_customers(spark, f"{made}/customers", samples.customers_for(1_000_000))
        for kind in ("orders", "customers"):
            csv.load_csv(spark, f"{made}/{kind}", f"{made}/{kind}-parquet", f"{made}/{kind}-rejects")
        return f"{made}/orders-parquet"

    times["generate_and_load_1m_sample"] = timed(sample, 1)
    million = spark.read.parquet(sample())
    times["profile_1m_sample"] = timed(lambda: profile(million))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": pathlib.Path(SF_DIR).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
