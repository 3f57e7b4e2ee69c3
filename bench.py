"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lumencat.plans.queries import QUERIES
from lumencat.session import local_session

HEADLINE = (
    "asset_details", "asset_json", "count_by_type", "substring_search", "asset_lookup_batch", "page",
    "ingest_asset_tags", "insert_assets", "tag_get_or_create", "add_tags", "patch_assets",
    "delete_restricted", "upsert_latest", "dq_catalog", "dq_shape", "text_index", "text_index_english",
    "text_match", "text_match_batch", "text_search", "nearby_radius", "nearby_batch", "knn_planar",
    "knn_batch", "cache_get", "cache_get_many", "queue_claim", "audit_diff", "audit_replay",
    "counts_incremental",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM's code paths and the file footers.
    QUERIES["count_by_type"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
