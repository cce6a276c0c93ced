"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  tables to read       (default /root/testdata/sf0.1)
BENCH_CPUS    local cores          (default 8)
BENCH_RUNS    timed runs per query (default 3, after two warm-ups)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from siftline.plans.catalog import queries
from siftline.sources import build_session

HEADLINE = (
    "score_leads",
    "score_leads_pages",
    "score_inline",
    "ensure_id",
    "ensure_id_stored_order",
    "enrich",
    "enrich_fanout",
    "enrich_gaps",
    "kpis",
    "kpis_fanout",
    "class_distribution",
    "score_histogram",
    "review_order",
    "repair_for_review",
    "apply_review_edits",
    "assign_batches",
    "build_requests",
    "flatten_scores",
    "score_with_model",
    "export_handover",
    "review_and_export",
    "first_keyword_many",
    "triage_kpis",
    "dashboard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="siftline-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog, seconds = queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 2):
            start = time.perf_counter()
            catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[2:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
