"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8). Each query runs once to warm
up and once timed; results go to the noop sink: every row is computed, nothing is
collected. What queries read from stored views and indexes is built before, as
figures of its own (build_*), which count in the total. Figures are told as they
come. After BENCH_SECONDS (default 1,200) no further query is begun and those left
are named: the JSON line always comes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paperfold import plans  # noqa: E402
from paperfold.plans import fixtures, retrievals  # noqa: E402
from paperfold.plans.registry import Tables  # noqa: E402
from paperfold.session import local_session  # noqa: E402

BUILDS = {"build_views": fixtures.order_views, "build_passage_index": retrievals.passage_index}

HEADLINE = (
    "header_field_total",
    "row_field_totals",
    "top_customer",
    "typed_view_rows",
    "records_with_topics",
    "flattened_records",
    "coerced_numbers",
    "merged_headers",
    "field_specs",
    "assigned_keys",
    "dedup_matches",
    "clean_documents",
    "surviving_confidence",
    "inserted_records",
    "scoped_by_topics",
    "title_chunks",
    "hybrid_search",
    "hybrid_search_many",
    "matched_schemas",
    "suggested_topics",
    "topic_deletion_chunks",
    "purge_impact",
    "status_changes",
    "retry_states",
    "request_rates",
    "chat_list",
    "document_inventory",
    "repeated_content",
    "text_blocks",
    "html_blocks",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    ends = time.monotonic() + float(os.environ.get("BENCH_SECONDS", "1200"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "paperfold-bench")
    times, left = {}, []

    def timed(name, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    def run(name) -> None:
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    for name, build in BUILDS.items():
        timed(name, lambda build=build: build(Tables(spark, folder)))
    for name in HEADLINE:
        if time.monotonic() > ends:
            left.append(name)
            continue
        run(name)
        timed(name, lambda name=name: run(name))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "not_run": left,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
