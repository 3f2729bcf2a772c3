"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query is fully
evaluated into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from rasterloom.plans import QUERIES, load_all
from rasterloom.session import local_session

HEADLINE = [
    "a14_map_catalog",
    "a04_store_round_trip",
    "b01_read_cost",
    "c06_nearest_neighbour",
    "c12_voxel_gather",
    "d03_percentile_linear",
    "d08_auc_folded",
    "d22_height_map",
    "d45_depth_contrast",
    "e01_auc_roll_null",
    "e05_rolled_jaccard",
    "f08_components",
    "f12_structure_tensor",
    "f16_column_bank",
    "g04_densest_window",
    "h02_burst_wall_clock",
    "j01_agreement",
    "j13_variant_funnel",
]


def main() -> None:
    load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
