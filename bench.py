"""Time the headline queries and print one JSON line.

Every query is written to the ``noop`` sink, so all of its rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from firnline.plans import registry  # noqa: E402
from firnline.session import local_session  # noqa: E402

HEADLINE = [
    "best_image_per_entry",
    "w5_day_mosaics",
    "a4_quality_metrics",
    "j1_stats_with_inventory",
    "w6_folds_large",
    "a1_norm_partials",
    "a2_norm_stats_large",
    "a44_contrast_stretch",
    "w10_large_raster_sample",
    "x10_feature_rows",
    "w21_patch_cells",
    "a38_patch_mosaic",
    "w8_nearest_fill",
    "w9_elevation_fill",
    "w12_terrain",
    "w13_non_overlapping_buffers",
    "w14_region_layers",
    "w16_outline_components",
    "w18_mask_segments",
    "j8_country_of_points",
    "j9_overlapping_pairs",
    "j14_nearest_centroids",
    "j18_rasterised_outlines",
    "a9_confusion_areas",
    "a17_ensemble_cells",
    "a22_two_threshold_sweep",
    "a28_temperature_losses",
    "a29_area_bounds",
    "a20_assembled_stats",
    "a33_piecewise_extrapolation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])  # starts the executor threads and compiles the scan path
    timings = {name: round(run(name), 3) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
