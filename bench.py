"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "voxel_history", "future_activity", "label_events", "frame_event_windows", "event_stats", "confidence_stats", "phase_imbalance", "voxel_agreement",
    "patch_tokens", "harmonic_power", "event_runs", "encode_crossings", "refractory", "lowpass", "action_chunk", "history", "label_outcome", "vector_stats",
    "delta_action", "assign_split", "locate", "ego_flow", "sample_forward", "dilate_ellipse", "region_metrics", "decay_memory", "interpolate_frames",
    "separation_thresholds", "evaluate_pair", "aggregate_pairs", "scene_tags", "tree_digest", "stream_voxels",
]


def main() -> None:
    from eventloom.plans import registry
    from eventloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    entries = registry.load()
    entries["voxel_history"].run(spark, sf).write.format("noop").mode("overwrite").save()  # start workers, load classes
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
