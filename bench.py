"""Headline timings.

Runs the ingest (raw lines from ``events`` -> parse -> templates -> parquet
table) once into a fresh folder, then the headline queries over the stored
table, each ``BENCH_REPEAT`` times after one warm-up; reports the median.
Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3), BENCH_QUERIES (comma list, default headline set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsift.plans import catalog, tables  # noqa: E402
from logsift.session import build_session, ensure_checkpoint_dir  # noqa: E402

HEADLINE = [
    "parse_all", "query_level", "query_message_regex", "query_ip", "query_page", "stats_levels",
    "stats_network", "stats_hourly", "file_network", "file_error_rate", "template_stats",
    "anomaly_volume_30d", "anomaly_error_rate_30d", "anomaly_new_templates",
    "anomaly_rare_templates", "anomaly_source_silence", "templates_mined", "anomaly_ml_30d",
    "anomalies_all",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
             if n in catalog.SPARK]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    # the shared folder named by spark.checkpoint.dir (a private temporary
    # folder only when the session names none)
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsift/bench-{uuid.uuid4().hex[:12]}"

    times: dict[str, float] = {}
    # ingest: parse and write the logs table; like the queries, one warm-up,
    # then the median of fresh writes (each into a new folder)
    ingest_runs = []
    for i in range(repeat + 1):
        t0 = time.perf_counter()
        tables.write_logs(tables.build_logs(spark, sf_dir), f"{scratch}/ingest-{i}")
        if i:
            ingest_runs.append(time.perf_counter() - t0)
    times["ingest"] = round(statistics.median(ingest_runs), 3)
    tables.logs(spark, sf_dir)  # the stored table the queries read

    for name in names:
        build = catalog.SPARK[name]
        _run(build(spark, sf_dir))  # warm-up
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(build(spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
