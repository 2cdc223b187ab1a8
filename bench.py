"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = (
    "ledger_clean", "exact_match_verdict", "document_verdicts", "outcome_counts", "merged_lines", "ledger_only",
    "supplier_baseline", "similar_suppliers", "quality_flags", "candidate_topk", "contiguous_groups", "kpi",
    "payables_export", "invoice_extract", "totals_extract", "layout_rebuild", "json_second_reader", "po_nearest_pair")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from checks.queries import QUERIES
    from ledgerloom.sources.derived import derived
    from ledgerloom.sources.scratch import release

    for table in ("ledger", "ledger_raw", "vendor", "invoice", "page", "ocr_page", "word", "second_reader"):
        derived(spark, sf_dir, table)
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    seconds = {}
    for name in only or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
