"""Times the headline queries; prints one JSON line.

Each query is built and run in full into a sink that keeps nothing. One run per
query warms up; the median of the timed runs counts. The tables are written once as
``FILES`` files each before that, untimed: a table of one file with one row group is
one task, whatever the number of cores.
"""

import json
import os
import statistics
import tempfile
import time

from quillspark.catalog.queries import QUERIES
from quillspark.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FILES = 16
TABLES = ["conversations", "documents", "events", "labels", "orders", "pages"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "convert_batch",
    "convert_mixed_batch",
    "convert_requests",
    "html_to_markdown",
    "convert_with_fallback",
    "csv_to_markdown",
    "json_to_markdown",
    "xml_to_markdown",
    "text_to_markdown",
    "status_report",
    "batch_summary",
    "assemble_parts",
    "resolve_collisions",
    "validate_requests",
    "resolve_options",
    "normalize_lang",
    "match_requests",
    "missing_files",
    "run_batch",
    "html_structure",
    "scan_csv",
    "fallback_plugin",
    "guarded_plugin",
    "convert_request_pages",
    "assemble_requested_parts",
    "rerun_batch",
    "write_markdown",
    "register_converter",
]


def spread(spark):
    """The tables as many files, in a folder of their own."""
    folder = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    for name in TABLES:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(FILES).write.parquet(f"{folder}/{name}.parquet")
    return folder


def timed(spark, query, folder):
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = local_session(CPUS, name="bench")
    seconds, folder = {}, spread(spark)
    for name in HEADLINE:
        timed(spark, QUERIES[name], folder)
        seconds[name] = round(statistics.median(timed(spark, QUERIES[name], folder) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total median wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
