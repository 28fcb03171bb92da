"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w03_points_in_windows", "w04_peak_ratio", "w07_edge_in_span", "w08_overlap_seconds", "w12_merge_adjacent",
    "t10_compact", "t12_check_continuity", "t13_check_overlaps", "d01_shots", "d08_appearance_timing",
    "f07_adaptive_sample", "f06_percentile_threshold", "v07_composition_grid", "m06_fill_gaps", "b03_match_scores",
    "j01_job_snapshot"]


def main() -> None:
    from clipline.plans import registry
    from clipline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    known["j06_count_by_status"](spark, sf_dir).collect()  # start the session before the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
