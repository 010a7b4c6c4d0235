"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs (the
median counts). Each query is written to the ``noop`` sink, so every output row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans import registry  # noqa: E402
from lectern.session import build_session  # noqa: E402

HEADLINE = [
    "doc_clean",
    "heading_carry_forward",
    "chunk_pack",
    "inverted_index",
    "bm25_topk",
    "keyword_topk",
    "vector_multi_query",
    "rerank_topk",
    "page_extract",
    "chunk_upsert_keep_vector",
    "relevance_class",
    "key_points",
    "next_event",
    "calendar_parse",
    "compact_history",
    "memory_topk",
    "intent_route",
    "eval_metrics",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for class loading; it is not one of the timed ones.
    registry.queries()["url_tail"](spark, root).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in chosen:
        took = []
        for _ in range(runs):
            started = time.perf_counter()
            registry.queries()[name](spark, root).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(took), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
