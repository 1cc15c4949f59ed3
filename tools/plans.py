"""Summarise the executed physical plan of every registered query.

usage: python tools/plans.py [sf_dir] > PLANS.md
Runs each library query once (noop sink) and counts, in the final AQE plan:
shuffles, broadcast and sort-merge / shuffled-hash joins, partial top-k
limits, Python stages, scans with pushed filters, and reused stages. Tables
that several queries share are built by the first query that needs them; a
second table lists them with the seconds they took.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from castwise.plans.catalog import all_queries  # noqa: E402
from castwise.session import STAGE_SECONDS, get_spark  # noqa: E402


def summarise(plan: str) -> dict:
    c = lambda pat: len(re.findall(pat, plan))
    return {
        "shuffles": c(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin"),
        "bcast_joins": c(r"BroadcastHashJoin"),
        "smj": c(r"SortMergeJoin"),
        "shj": c(r"ShuffledHashJoin"),
        "nested_loop_1row": c(r"BroadcastNestedLoopJoin"),
        "topk_partial": c(r"WindowGroupLimit .*Partial") + c(r"TakeOrderedAndProject"),
        "python": c(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas"),
        "pushed_filter_scans": c(r"PushedFilters: \[[^\]]+\]"),
        "scans": c(r"FileScan parquet"),
        "reused": c(r"ReusedExchange|ReusedSubquery|reuse"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    print(f"# Executed plan shapes ({sf_dir})\n")
    print("Counts from the final adaptive plan of each query (`tools/plans.py`). "
          "`nested_loop_1row` joins attach one-row scalars (global fill values, "
          "bounds, counts); every other join is an equi-join. A query that reads a shared "
          "table shows only its own plan; the tables are listed below.\n")
    keys = list(summarise("").keys())
    print("| query | " + " | ".join(keys) + " |")
    print("| --- |" + " --- |" * len(keys))
    for name, query in all_queries().items():
        df = query.build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| `{name}` | " + " | ".join(str(s[k]) for k in keys) + " |", flush=True)
    print("\n| shared table | seconds to build (tables it needs included) |\n| --- | --- |")
    for name, seconds in STAGE_SECONDS.items():
        print(f"| {name} | {seconds} |")


if __name__ == "__main__":
    main()
