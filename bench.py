"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from docloom.plans.catalog import QUERIES  # noqa: E402
from docloom.session import build_session  # noqa: E402

HEADLINES = [
    "L1_upsert_documents", "L2_query_library", "L4_refresh_sources", "N6_segment_chapters", "N15_assign_ids", "N10_inline_atoms",
    "N17_assemble_documents", "N18_chapter_digests", "N22_term_statistics", "T1_protect_blocks", "T4_cache_lookup", "T7_plan_batches",
    "T8_build_requests", "T10_parse_outputs", "T11_validate_outputs", "T17_chapter_progress", "J1_upsert_jobs",
    "J2_state_change_events", "J5_mark_interrupted", "J12_parse_view", "C2_enqueue_turns", "C5_neighbour_context", "C7_fit_requests",
    "C10_extract_citations", "K1_replay_commands", "K2_active_sessions", "Q2_check_uniques", "X1_stream_commands",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(f"local[{cpus}]", "docloom-bench", **{
        "spark__sql__shuffle__partitions": cpus, "spark__driver__memory": os.environ.get("BENCH_MEMORY", "12g")})
    # start-up of the JVM and of the Python workers is not part of a query
    QUERIES["L3_summarize_documents"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    # N15 is the first to need the normalized tables and pays for building them
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
