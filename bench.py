"""Times every query but those of training data; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

Headline queries run once cold and three times warm (the median counts), the others once each. Rows a
second are those of the table that a query reads (events or embeddings); an event stands for a frame of
32 ms, so the real-time factor of a query over events is its seconds over 0.032 seconds a row.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from cadenza.plans import catalogue, chain, voices
from cadenza.session import build_session

HEADLINE = ("flagship", "hysteresis_state", "energy_islands", "interval_merge", "rolling_cv_gate", "turn_zscore", "noise_floor_fold", "cooldown_thinning", "asof_latest_flag", "interval_join", "fusion_decision", "pairwise_cosine", "centroid_verdict", "online_cluster")
VECTORS = ("pairwise_cosine", "pair_regimes", "centroid_verdict", "variance_ratio", "nearest_centroid", "online_cluster", "agglomerative", "verified_voices")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("events", "embeddings")}
    times, cold, others = {}, {}, {}
    run = catalogue.QUERIES | voices.QUERIES | chain.QUERIES
    for name in sorted(run, key=lambda n: n not in HEADLINE):
        runs = []
        for _ in range(4 if name in HEADLINE else 2):
            start = time.perf_counter()
            run[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        (times if name in HEADLINE else others)[name] = round(statistics.median(runs[1:]), 4)
        cold[name] = round(runs[0], 4)
    per_second = {n: round(rows["embeddings" if n in VECTORS else "events"] / t) for n, t in (times | others).items()}
    factors = {n: round(t / (0.032 * rows["events"]), 7) for n, t in (times | others).items() if n not in VECTORS}
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "others": others, "cold": cold, "rows_per_second": per_second, "real_time_factor": factors, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
