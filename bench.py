"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modwarden.plans import QUERIES  # noqa: E402
from modwarden.session import build_session  # noqa: E402
from modwarden.sources.readers import INPUT_PARTITIONS  # noqa: E402

HEADLINE = (
    "lexicon_verdict", "lexicon_stats", "fuse_verdict", "max_window_score", "dedupe_keep_first", "leakage_removal",
    "stratified_split", "prepare_corpus", "threshold_sweep", "pick_thresholds", "last_write_wins", "session_stats",
    "refine_verdict", "keep_newest_n", "priority_admission", "image_rollup", "otsu_threshold", "extract_parts",
    "content_key", "stream_upsert", "stream_media_lifecycle", "detect_units", "lexicon_verdict_by_join", "score_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cores}]", cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(INPUT_PARTITIONS, str(cores))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        # The best run, so that class loading and compilation are not charged to a query.
        times[name] = round(min(taken), 3)
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": f"total seconds over the headline queries, best of {runs}",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "documents_per_second": {
            n: round(n_docs / times[n]) for n in ("lexicon_verdict", "fuse_verdict", "max_window_score", "dedupe_keep_first") if n in times
        },
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
