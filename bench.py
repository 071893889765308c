"""Times the headline queries on one data folder and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from inkweave.plans.catalog import QUERIES  # noqa: E402
from inkweave.session import local_session  # noqa: E402

HEADLINE = (
    "scan_text",
    "html_text",
    "main_content",
    "page_title",
    "json_lines_text",
    "csv_rows_text",
    "assemble_parts",
    "content_or_fallback",
    "document_registry",
    "word_count",
    "clean_text",
    "chunk_documents",
    "task_fanout",
    "execute_tasks",
    "evaluate_examples",
    "quality_stats",
    "stats_documents",
    "example_lineage",
    "export_jsonl",
    "process_documents",
    "quick_process",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, app_name="inkweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["char_count"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the session
    seconds, again = {}, {}
    for times in (seconds, again):  # the first run compiles code and starts Python workers, the second is warm
        for name in HEADLINE:
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale, "warm": again, "warm_value": round(sum(again.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
