"""Time the headline queries: one JSON line with the warm seconds of each and their sum."""

from __future__ import annotations

import json
import os
import time

from ledgerlume.plans.catalog import QUERIES
from ledgerlume.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINES = [
    "a01_report_totals", "a03_report_by_customer", "report_month_totals", "a08_tax_totals", "a09_service_profit", "a35_monthly_evolution",
    "j02_tax_with_invoice", "o06_latest_per_customer", "q07_queue_report", "q11_repeated_uploads", "w01_field_history", "x11_normal_texts",
    "x23_redacted_texts", "e01_classify", "e09_extract_by_labels", "c05_resolve", "g17_fiscal_confidence", "q16_rate_limits",
]


def main() -> None:
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):  # the second run counts: code is compiled by then
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
