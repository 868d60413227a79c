"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Every query runs once to warm
up and then ``$BENCH_RUNS`` times, each time from building the plan to the last
row written to a sink that discards it; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from recuento.catalog import all_queries
from recuento.session import build_session, stored_tables

HEADLINE = (
    "scan_csv",
    "snapshot_roundtrip",
    "mutate_sequential",
    "parse_dmy",
    "repair_mojibake",
    "band_numeric",
    "recode_dictionary",
    "geo_lookup_join",
    "mean_days",
    "distinct_count",
    "weighted_population",
    "share_pct",
    "share_band_sum",
    "rate_per_100k",
    "region_measures",
    "quartile_class",
    "topk_share",
    "wide_to_long_sum",
    "order_by_value",
    "profile_columns",
    "raw_registry_profile",
    "polygon_centroid",
    "registry_clean_december",
    "registry_clean_july",
    "profile_sex_age",
    "profile_sex_status_age",
    "schooling_share_by_status",
    "mean_days_to_location",
    "place_found_alive",
    "city_rates",
    "national_rates_by_status",
    "municipal_map",
    "narrative_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    wanted = sys.argv[1:] or HEADLINE

    times: dict[str, float] = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            with stored_tables(spark):
                start = time.perf_counter()
                catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
