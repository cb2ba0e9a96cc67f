"""Time the headline queries: one warm-up, then the median of three full runs.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from starwake.checks import load
from starwake.session import local_session

HEADLINES = [
    "top_repos",
    "top_repos_raw",
    "shock_movers_raw",
    "metadata_from_events",
    "enrich_events",
    "backfill_events",
    "repo_rollup_archive",
    "trending_week",
    "shock_movers",
    "topic_rotation",
    "category_summary",
    "activity_summary",
    "events_per_hour",
    "market_category_movers",
    "market_brief",
    "repo_brief",
    "search_repos",
    "related_repos",
    "repo_summary_report",
    "ai_signal",
    "classify_question",
    "extract_repo_mention",
]


def timed(run, spark, folder: str) -> float:
    begun = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    checks = load()
    chosen = list(checks) if "--all" in sys.argv else HEADLINES
    took = {}
    for name in chosen:
        timed(checks[name].run, spark, folder)
        runs = [timed(checks[name].run, spark, folder) for _ in range(3)]
        took[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
