"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run to completion through the ``noop`` sink, so the whole result is computed
and nothing is collected. One warm-up run, then the median of ``$BENCH_RUNS`` (default 2) runs. After
``$BENCH_SECONDS`` (default 1500), or on a termination signal, what is done so far is printed; a query that was
run once only then counts with that run.
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from corpuslane.plans import catalog  # noqa: E402
from corpuslane.session import build_session  # noqa: E402

HEADLINE = [
    "vector_leg", "pack_context", "keyword_leg_or", "rrf_fusion", "identifier_scan", "note_scan", "redact_ids",
    "text_windows", "dedupe_text", "flag_degenerate", "trim_history", "owner_query", "gate_coverage", "split_sections",
    "index_lines", "reconcile_manifest", "find_exact", "find_quotes", "resolve_titles", "mention_table",
    "match_owners", "topic_overlap", "cut_to_ceiling", "ordered_assembly", "summarise", "rank_grid",
    "directory_asof", "allowed_messages", "resolve_citations", "best_reason", "redact_names", "assign_keys", "answer_stream", "rule_units",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, began = {}, time.perf_counter()
    deadline = float(os.environ.get("BENCH_SECONDS", "1500"))

    def report() -> None:
        done = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}
        if len(seconds) < len(names):
            done["not_run"] = [n for n in names if n not in seconds]
        print(json.dumps(done), flush=True)

    def stopped(*_) -> None:
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, stopped)
    for name in names:
        if time.perf_counter() - began > deadline:
            break
        first = once(name)
        seconds[name] = round(first, 3)
        again = []
        while len(again) < runs and time.perf_counter() - began < deadline:
            again.append(once(name))
        if again:
            seconds[name] = round(statistics.median(again), 3)
        print(f"{name}: first {first:.2f}s median {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
