"""Timings of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores.  Every
query runs ``RUNS`` times after one warm-up run, written to the no-op sink; the
reported figure is the median, plan building included.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from fieldsift.queries.registry import QUERIES

HEADLINE = (
    "p1_text_gate",
    "s2_page_assembly",
    "t4_redecode_cp1252",
    "t5_normalized_documents",
    "t6_line_table",
    "t9_labeled_value",
    "t15_material_score",
    "r1_top_material_line",
    "r2_description_lines",
    "t19_extract_documents",
    "t19_extract_sheets",
    "c5_events",
    "c7_diagnostics_text",
    "c2_context_validation",
    "j2_context_of_documents",
    "p8_approval",
    "e2_generate",
    "a1_batch_totals",
)
RUNS = 2


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldsift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # The given tables are single files with one row group.
        .config("fieldsift.inputPartitions", 2 * int(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def run_once(spark: SparkSession, name: str, data: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        run_once(spark, name, data)
        timings[name] = round(
            statistics.median(run_once(spark, name, data) for _ in range(RUNS)), 3
        )
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    scale = re.search(r"sf([0-9.]+)", data)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
                "documents_per_sec": round(documents / timings["t19_extract_documents"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
