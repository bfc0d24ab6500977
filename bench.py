"""Times the headline queries, or those named, over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

python bench.py [NAME...]: any registered query, as m06_import, m12_rebuild_same_ranges, q17_a.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["q01", "q01_b", "q03", "q05", "q06", "q09", "q13", "q15_a", "q15_b", "q15_c", "q16", "q17", "q17_a", "q17_b", "q18", "q18_a", "q18_b", "q21", "ssb_group_by_date", "ssb_filtered_sum", "ssb_part_join", "j01_copartitioned_join", "m01_equal_width"]


def main() -> None:
    from tessera.plans import registry
    from tessera.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_sql_warehouse_dir=tempfile.mkdtemp(prefix="tessera-warehouse-"))
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "warm wall time of all headline queries" if not sys.argv[1:] else "warm wall time of the named queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
