"""One JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from walkgraph.plans.queries import QUERIES  # noqa: E402

HEADLINES = [
    "walks_generate", "global_rank_handoff", "visit_counts", "personalized_rank", "update_walks", "follows", "follower_counts",
    "latest_event_per_kind", "parse_pubkeys", "resolve_ids", "update_follows", "arbiter_decisions", "exact_rank_trade",
    "walks_visiting_all", "walks_visiting_limited", "index_consistency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
