"""Time the headline queries: best of three warm runs each, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "upgrade_plan",
    "upgrade_decisions",
    "single_line_references",
    "rewritten_project_files",
    "repository_updates",
    "merge_request_plan",
    "triggered_migrations",
    "most_recent_branch",
    "requested_repositories",
    "undo_plan",
    "undo_report_lines",
    "pages_with_terms",
    "call_inventory",
    "declaration_inventory",
    "rules_in_order",
    "refreshed_statuses",
    "status_report_lines",
    "request_rates",
    "burst_runs",
    "streamed_request_rates",
]
RUNS = 3


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from fleetbump.queries import QUERIES
    from fleetbump.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "fleetbump-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in wanted:
        first = run(name)
        # A run of a minute is warm enough; the others are repeated.
        seconds[name] = round(first if first > 60 else min(run(name) for _ in range(RUNS)), 3)
        print(name, seconds[name], f"(first {first:.1f})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
