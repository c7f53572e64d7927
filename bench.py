"""Headline queries at one scale; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
    BENCH_QUERIES (comma list, default all below).

Each query is run to completion with the ``noop`` sink (the whole plan
executes, nothing is collected to Python) and timed on its own.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import registry  # noqa: E402
from quire.session import local_session  # noqa: E402

HEADLINE = [
    "related_on_demand",   # flagship: one document against the corpus
    "pair_table",          # exact cosine join above the stored threshold
    "related_all",         # top-3 related for every document, among those pairs
    "top_terms",           # 1-3-gram TF-IDF, band filter, top 3 per document
    "trending",            # top terms of the newest documents
    "term_statistics",     # per n-gram document count and weight sum
    "ngram_postings",      # 1-3-gram expansion and per-document counts
    "feed",
    "search",
    "detail",
    "memo_parse",          # header/body/footer of every memo
    "page_blocks",         # HTML block job over all pages
    "entity_matches",      # dictionary matching of every document
    "ingest_pages",        # pages -> blocks -> memo -> records
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 4, app="quire-bench")
    # Warm the JVM (JIT of regex, aggregation and join code) and the Python
    # workers once on the smallest scale, so the first timed query does not
    # carry the start-up cost.  Timed runs below are full runs at sf_dir.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("related_on_demand", "top_terms", "memo_parse", "entity_matches", "feed"):
        registry.QUERIES[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
