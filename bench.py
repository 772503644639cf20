"""Time the headline queries: one JSON line with seconds per query.

Each query runs to a no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from busline.plans import QUERIES
from busline.session import build_session

HEADLINE = [
    "classify_telemetry", "stateful_ingest", "trip_context", "route_progress", "enriched_telemetry", "stops_ahead",
    "alert_persistent_off_route", "behaviour_windows", "alert_stationary", "alert_communication_loss",
    "alert_trip_not_started", "dwell", "smoothed_speed", "eta_stream_records", "stops_near", "connecting_routes",
    "progress_requests", "trip_states", "register_buses", "report_consensus", "trust_profiles", "hybrid_prediction",
    "hourly_means", "seasonal_models", "stationary_hotspots",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("busline-bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the JVM and of the code generator is not part of any query
    QUERIES["route_lengths"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
