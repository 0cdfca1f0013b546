"""Headline-query timings. Prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query's full plan is executed with the `noop` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p1_preprocess",
    "p5_low_resource_ladder",
    "c4_cue_lexicon",
    "e1_lexicon_candidates",
    "f8_verify",
    "g4_select",
    "e5_augment_rounds",
    "e5_verifications",
    "h1_merge_train",
    "i3_classification_metrics",
    "d3_normalize_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from flipside.plans.queries import QUERIES
    from flipside.session import build_session
    spark = build_session(cpus, shuffle_partitions=max(8, 2 * cpus))
    # warm the JVM and Python workers once (not timed)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
