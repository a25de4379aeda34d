"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once as a warm-up, then is timed with a full execution into
the ``noop`` sink (every row computed, nothing collected to the driver).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.cases import load_all  # noqa: E402
from quarry.session import get_spark  # noqa: E402

HEADLINE = [
    "v04_fuel_panel",          # flagship panel: scans -> fill -> shares -> cutoffs -> clustering -> daily panel
    "v03_consumption_table",
    "v13_npv_stats",
    "v14_npv_sensitivity",
    "v17_monte_carlo",
    "v18_real_option",
    "v06_freight_costs",
    "v09_market_sourcing",
    "v11_plant_waterfall",
    "v07_plan_audit",
    "w04_sliding_windows",
    "m06_forecast_drift",
    "m08_scenario_panels",
    "r01_reconcile",
    "v05_municipal_indicators",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = get_spark(f"local[{cpus}]", int(cpus))
    cases = load_all()
    names = [n for n in (only or HEADLINE) if n in cases]
    times = {}
    for n in names:
        c = cases[n]
        c.run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = time.perf_counter()
        c.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf_txt = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_txt)
    except ValueError:
        sf = sf_txt
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus),
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
                      "spark": spark.version}))


if __name__ == "__main__":
    main()
