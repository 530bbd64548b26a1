"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone import catalog

HEADLINE = ("scoreboard", "run_metrics", "nms", "match_counts", "average_precision", "coco_ap", "slices_grouping_sets", "paired_winners", "cosine_topk", "maxtoken_similarity", "retrieval_search", "hough_histogram", "supcon_loss", "content_dedup", "background_cells")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["method_thumbs"](spark, sf_dir).collect()  # start-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
