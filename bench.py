"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR is the input folder, BENCH_CPUS the number of local cores. Every query is run once to
warm up and then three times; the median counts. Results go to the `noop` sink, so all rows are made
and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from palisade.session import build_session  # noqa: E402

HEADLINES = [
    "corpus_findings", "rule_scan", "secret_scan", "drift_scan", "history_scan", "git_log_lines",
    "contextual_score", "dedupe_findings", "scan_rollup", "hourly_trend", "scan_risk", "top_vulnerabilities",
    "cve_mentions", "enrich_cves", "intel_summary", "top_risks", "scan_compliance", "keyword_controls",
    "match_advisories", "npm_manifest", "apply_fixes", "sarif_results", "json_report_lines", "idle_periods",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm, median of 3",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
