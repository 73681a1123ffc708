"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated list (or ``all``) instead of the headline set.
"""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "ext08_enrich_counts", "ext08_enrich", "flt04_off_topic", "fn04_clean_html", "fn12_summaries", "fn30_article_entities",
    "jn01_new_urls", "win01_article_ids", "agg04_company_register", "agg05_psc_dedup", "rf20_annotate", "agg07_portfolio",
    "gr01_vertices", "gr03_degree", "gr05_employment_state", "jn05_relation_endpoints", "agg15_extraction_score",
    "srh02_vector", "srh03_hybrid", "srh05_batch_search", "rep02_daily_report", "jn03_vector_dedup", "jn02_word_set_dedup",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from ownerlens.plans.catalog import QUERIES
    from ownerlens.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(cores, shuffle_partitions=max(8, int(cores) if cores.isdigit() else 8))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
