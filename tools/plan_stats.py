"""Per-query physical plan statistics from the final (post-AQE) plans, as a Markdown table.

Usage: python tools/plan_stats.py [sf_dir] > table.md
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from explain import tree  # noqa: E402

COUNTS = {
    "scans": r"FileScan parquet",
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "1-partition shuffles": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "reused": r"ReusedExchange",
    "windows": r"\bWindow \[",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "BNLJ": r"BroadcastNestedLoopJoin",
    "subqueries": r"Subquery subquery",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from lanescope.plans.registry import QUERIES
    from lanescope.session import local_session
    spark = local_session(8, 8)
    print("| query | " + " | ".join(COUNTS) + " |")
    print("|---|" + "---|" * len(COUNTS))
    for name, fn in QUERIES.items():
        t = tree(fn(spark, sf_dir))
        lines = t.splitlines()
        row = [str(sum(1 for ln in lines if re.search(p, ln)
                       and (name_ == "reused" or "ReusedExchange" not in ln)))
               for name_, p in COUNTS.items()]
        print(f"| {name} | " + " | ".join(row) + " |", flush=True)


if __name__ == "__main__":
    main()
