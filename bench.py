"""Times the headline queries once each and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every result is consumed whole, without being brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from nearpass.checks.registry import QUERIES  # noqa: E402
from nearpass.session import local_session  # noqa: E402

HEADLINES = (
    "daily_metrics",
    "approach_stats",
    "approach_summary",
    "velocity_histogram",
    "size_classes",
    "approach_window",
    "latest_approach",
    "dedupe_approaches",
    "object_profile",
    "cad_enriched",
    "watchlist_top100",
    "orbit_class_dist",
    "fireball_daily",
    "flatten_messages",
    "candidates",
    "esa_parse",
    "resolve_sbdb",
    "resolve_profiles",
    "identifier_cascade",
    "object_search",
    "change_detection",
    "upsert_current",
    "classified_fetches",
    "refresh_worklist",
    "planned_windows",
    "profile_document",
    "stream_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    # Start the workers and the code generator before the clock runs.
    QUERIES["approach_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
