"""Executed-plan summary of registered queries at sf0.01: shuffles,
broadcasts, join kinds, Python nodes and pushed filters.

Usage: python tools/plan_summary.py [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans import registry as R  # noqa: E402
from quire.session import local_session  # noqa: E402

SHUFFLE = r"Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobin)"
PYTHON = r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython"


def main() -> None:
    spark = local_session(8, shuffle_partitions=8)
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(R.QUERIES)
    print("| query | shuffles | broadcasts | SMJ | BHJ | BNLJ/cartesian | python nodes "
          "| pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for n in names:
        df = R.QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # AQE shows the final plan
        p = df._jdf.queryExecution().executedPlan().toString()

        def c(pat: str) -> int:
            return len(re.findall(pat, p))

        pushed = sorted({m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", p) if m})
        print(f"| {n} | {c(SHUFFLE)} | {c('BroadcastExchange')} | {c('SortMergeJoin')} "
              f"| {c('BroadcastHashJoin')} | {c('BroadcastNestedLoopJoin|CartesianProduct')} "
              f"| {c(PYTHON)} | {'; '.join(pushed)[:80]} |", flush=True)


if __name__ == "__main__":
    main()
