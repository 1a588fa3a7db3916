"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query is fully executed (noop sink, no
collect); a warm-up pass on the smallest data set runs before timing."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsframe.plans.registry import queries  # noqa: E402
from newsframe.session import build_session  # noqa: E402

HEADLINE = [
    "clean_article_text", "summary_lead", "credibility_heuristic", "credibility_penalty",
    "keywords_freq", "keywords_rake", "keywords_embedding", "extract_keywords",
    "polarity", "analyze_bias", "analyze_sentiment",
    "extract_links", "distinct_links_topn", "robots_filter", "extract_article",
    "embed_texts", "similar_pairs", "drop_near_duplicates", "similar_vector_pairs",
    "cli_summarize", "analyze_articles",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 4)
    qs = queries()
    # warm-up (JVM, code generation, Python workers) on the smallest data,
    # so the first timed query is not charged for it
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("cli_summarize", "keywords_rake", "keywords_embedding"):
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, base).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(base.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
