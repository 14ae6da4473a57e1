"""Bench: full-pipeline scoring (write included) and the other headline jobs.

Every query starts from the raw tables' shared workspace; ``score_events``
starts from nothing, so it pays for everything up to the written verdicts.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# each of these runs on the workspace score_events has built
FOLLOW_UPS = (
    "normalize_event_entities",
    "dedupe_ingest",
    "build_links",
    "build_nodes",
    "taint_levels",
    "cluster_stats",
    "cluster_members_r",
    "entity_risk",
    "evidence_bundle",
    "identity_components",
    "assign_splits",
    "group_kfold",
    "evaluation_report",
    "calibration_deciles",
    "threshold_curve",
    "coordinate_ascent",
    "dataset_profile",
    "latency_summary",
    "ranked_queue",
    "stream_velocity",
)


def main() -> None:
    from ringweave.plans.catalog import QUERIES
    from ringweave.session import build_session, shared_root
    from ringweave.sources.payments import read_table

    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session("ringweave-bench", cpus=CPUS, spark__sql__shuffle__partitions=CPUS)
        read_table(spark, SF_DIR, "orders").count()  # JVM and reader start-up
        times: dict[str, float] = {}

        def run(name: str, path: str | None = None) -> None:
            start = time.perf_counter()
            rows = QUERIES[name](spark, SF_DIR)
            if path:
                rows.write.mode("overwrite").parquet(path)
            else:
                rows.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)

        verdicts = f"{shared_root(spark)}/bench-verdicts"
        run("score_events", verdicts)
        scored = spark.read.parquet(verdicts).count()
        for name in FOLLOW_UPS:
            run(name)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "score_events_full_pipeline",
                "value": times["score_events"],
                "unit": "sec",
                "events": scored,
                "events_per_sec": round(scored / times["score_events"], 1),
                "total_sec": round(sum(times.values()), 3),
                "queries": times,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
