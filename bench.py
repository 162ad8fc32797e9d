"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to its last row (the rows go to Spark's noop sink). Plan building,
optimisation and code generation are part of every figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlgauge.plans.session import build_session, scratch_path  # noqa: E402
from verification import fixtures as fx  # noqa: E402
from verification.registry import QUERIES  # noqa: E402

HEADLINE = [
    "page_text_signals", "sig_anchors", "fetch_frontier", "robots_blocked_agents", "check_structured_data",
    "api_endpoints", "score", "check_results", "recommendations", "fleet_rollup", "detect_subpages",
    "subpage_audit", "nested_result", "report_txt", "compare_pivot", "site_ranking", "stream_complete",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffle_bytes(df) -> int:
    """Bytes written to shuffles by one run of ``df``."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    total, stack = 0, [qe.executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleBytesWritten").value()
            kids = node.children()
            stack += [kids.apply(i) for i in range(kids.size())]
    return total


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # The first query also loads classes; it is timed apart from the rest.
    start = time.time()
    drain(QUERIES["page_scan"](spark, sf_dir))
    warm = time.time() - start
    for name in HEADLINE:
        start = time.time()
        drain(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)

    # Steady rates over a stored resource table, the form an audit job reads.
    from crawlgauge.operators import audit, scoring
    from crawlgauge.sources.tables import resource_scan, write_resources

    stored = scratch_path(spark, "bench-resources")
    write_resources(fx.resources(fx.pages(spark, sf_dir)).drop("kind"), stored)
    scores = scoring.scan_scores(audit.audit(resource_scan(spark, stored)))
    start = time.time()
    moved = shuffle_bytes(scores)
    audit_s = time.time() - start
    n = fx.pages(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "first_scan_sec": round(warm, 3),
                "pages": n,
                "pages_per_sec_signals": round(n / times["page_text_signals"], 1),
                "scans_per_sec_stored_audit": round(n / audit_s, 1),
                "shuffle_bytes_per_scan": round(moved / n, 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
