"""Headline-query benchmark.

Runs the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed end to end into Spark's no-op sink (no driver
collect); the reported time is the median of $BENCH_RUNS warm runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "user_split_counts",     # sentence pipeline: split, clean, filters, user split
    "hierarchy_spans",       # global index + spans (distributed prefix sum)
    "graded_groups",         # 16-item keyed chains (7 equi-joins)
    "char_ngram_tfidf",      # char n-gram TF-IDF
    "group_ranking",         # graded group scoring, NDCG / MRR / margin loss
    "blend_sweep",           # 21-point blend-weight sweep
    "unknown_threshold",     # 101-point open-set threshold sweep
    "cap_per_source",        # capped stratified sampling
    "centroids",             # vector means
    "surface_cue_counts",    # surface cues
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from styleframe.plans import registry
    from styleframe.session import get_session

    spark = get_session(f"local[{cpus}]", app="styleframe-bench",
                        shuffle_partitions=max(8, int(cpus) * 2))
    qs = registry.queries()
    names = only or list(HEADLINE)
    times: dict[str, float] = {}
    for name in names:
        fn = qs[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": m.group(1) if m else sf_dir, "runs": runs,
           "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
