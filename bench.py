"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed in
full with the ``noop`` sink (every row computed, nothing sent to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.plans import registry  # noqa: E402
from cadenza.session import local_session  # noqa: E402

HEADLINE = [
    "recommend", "topk_cosine", "fuzzy_search", "fuzzy_join", "replay_requests",
    "feature_wide", "describe_rows", "hash_embed", "ingest_json", "dedup_first",
    "playlist_state", "register_unique_name", "request_runs", "apply_projection",
    "fit_projection", "histogram_year",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    registry.load_all()
    # warm-up: JVM, Python workers, file listing
    registry.QUERIES["vector_norm"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64, numPartitions=int(cpus) if cpus.isdigit() else 8).mapInPandas(
        lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
