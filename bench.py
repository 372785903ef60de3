"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Every query is run to the end of its result through a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "J26_top_spenders",
    "Q02_top_customers_year",
    "Q03_orders_by_status",
    "Q05_daily_users",
    "Q12_window_vocabulary",
    "A01_aggregate_subjobs",
    "A04_size_histogram",
    "A05_pool_summary",
    "A14_duration_histogram",
    "A19_counter_total",
    "F09_ignored_path",
    "F17_should_replicate",
    "J01_manifest_diff",
    "J04_column_drift",
    "J05_config_diff",
    "J06_mirror_routes",
    "J07_find_overlaps",
    "J14_offsets_for_times",
    "J17_map_schema_ids",
    "J19_hrw_assign",
    "J28_barrier",
    "J29_reconcile_deletes",
    "P11_transcode",
    "P12_enrich_headers",
    "P13_event_body",
    "P18_to_display",
    "P24_verify_checksums",
    "W01_latest_per_key",
    "W11_committable_offsets",
    "W13_split_batches",
    "W20_hysteresis",
    "W21_prune_runs",
    "T01_replicate_stream",
    "T05_journal_to_plan",
    "T08_apply_catalog_events",
    "T13_counter_rate",
    "T16_sustained",
    "T20_progress_deltas",
]


def main() -> None:
    from strandline import get_session
    from strandline.plans.registry import load_all, spark_callable

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "strandline-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    entries = load_all()
    times: dict[str, float] = {}
    run = lambda name: (
        spark_callable(entries[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
    )
    run(HEADLINE[0])  # start-up is not part of any query
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - started, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
