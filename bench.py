"""Wall seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm the JVM and then timed over its full result (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = """
html_to_markdown clean_modes build_blocks chunk_id chunk_stats acronyms_global count_tokens alias_normalize
bm25_index bm25_topk vector_topk hybrid_pool pack_context rerank_candidates
intake_action fold_uia_state validate_skills apply_decisions fold_insight_state build_surveys batch_completion
shortlist best_insight first_open_batch actionable_before_turns assemble_reply progress_sessions recent_events
""".split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from groundloom.plans import load
    from groundloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    queries, _ = load()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")

    def run(name: str) -> float:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"))}))


if __name__ == "__main__":
    main()
