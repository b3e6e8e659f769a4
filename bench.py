"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from emberline.plans.catalog import QUERIES
from emberline.session import build_session

HEADLINE = (
    "ingest_dedupe", "polygon_match", "nearest_polygon", "industrial_join", "forest_flag",
    "recurrence_stats", "neighbourhood", "alert_state", "frp_thresholds", "weak_label",
    "balance_sample", "hex_rollup", "register", "kpi", "chart_bins", "verified_tag",
    "radius_search", "nearest_responders", "audit_fold", "dispatch_plan", "dnbr_windows",
    "background_temperature", "fire_temperature", "features_projection",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    QUERIES["corpus_span"](spark, sf_dir).collect()      # starts the session, not timed
    timings = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
