"""Headline queries at one scale; prints one JSON line with seconds per query, for a first and a second call."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandweave.plans import catalog  # noqa: E402
from strandweave.session import build_session, release_tables  # noqa: E402

HEADLINE = [
    "neighbour_pairs", "pair_transforms", "volume_pair_summary", "duplicates_by_score", "nearest_neighbour",
    "class_statistics", "class_radius", "assign_to_centres", "swapped_towards_mean", "pruned_edges", "tracked_chains",
    "tracked_merging_chains", "chain_ends", "chain_statistics", "class_overlap", "error_distances", "exponential_fit",
    "price_quantiles", "user_sessions_as_chains", "shifted_images",
]
#: Over the event table (a third of its rows in one volume); not part of the total.
LARGE = ["event_pairs", "event_duplicates", "event_chains"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["volume_pair_summary"](spark, sf_dir).collect()  # starts executors and workers, not counted
    times, again, large = {}, {}, {}
    for name in HEADLINE + LARGE:
        for into in (times, again) if name in HEADLINE else (large,):  # the second call has its code compiled
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - start, 3)
            release_tables(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "second_total": round(sum(again.values()), 3), "second": again, "large": large, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
