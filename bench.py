"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose the data and the number of threads.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from folio.plans import registry

HEADLINES = (
    "E10_latency_distribution", "E14_lane_summary", "E1_latest_results", "F1_normalized_title", "F3_text_quality", "L6_reading_order", "L8_mark_margins",
    "T12_build_tree", "T10_validate_tree", "T14_map_toc", "T17_node_sizes", "T18_merge_small", "T22_own_text", "V1_library_listing", "V6_activate", "R5_page_slices",
    "R8_resolve_references", "R13_budget_violations", "E5_compare_extraction", "E6_evidence_reachability", "G1_extract_links", "G4_unreachable", "ST3_usage_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoint").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", f"file://{folder}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    noop = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    noop("E10_latency_distribution")  # starts the session's code
    took = {}
    for name in HEADLINES:
        began = time.time()
        noop(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
