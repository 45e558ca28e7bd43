"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from fieldglass.session import session

HEADLINES = ["tendency", "outcome_mix_weighted", "opponent_adjusted", "situational_value", "scheme_splits", "mine_cells", "prior_strength", "cell_statistics", "mine_tells", "tells_topk", "forward_validation", "play_cues", "play_features", "detection_metrics", "dedupe_last", "asof_prior", "resample_grid", "velocity", "median_filter", "sessions", "confusion_matrix", "f1_by_class", "average_precision", "iou_pairs", "centroid_assign", "paged_listing"]


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    from fieldglass.catalog import QUERIES

    QUERIES["tendency"](spark, where).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
