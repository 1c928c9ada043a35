"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "heat_score", "heat_delta", "entity_join", "contract_timeline", "pressure_delta", "weekly_buckets", "rank_score",
    "candidate_reasons", "top_breakdown", "corpus_stats", "field_audit", "inbox_top", "domain_group", "arm_stats",
    "pareto_frontier", "verdict_validate", "narrow_top5", "tfidf_rank", "vector_topk", "section_diff", "section_split",
    "release_rollup", "portfolio", "version_pairs", "fk_coverage", "stream_daily",
]


def main() -> None:
    from gazette.plans import catalog
    from gazette.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("gazette-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query, so that the first timed one does not pay for starting the session.
    catalog.QUERIES["headline_stats"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
