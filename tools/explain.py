"""Print the final (post-AQE) physical plan tree of registered queries.

Usage: python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def tree(df) -> str:
    df.collect()                  # run this very query execution, so AQE has a final plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep, skip_at = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-|"))
        if skip_at is not None:
            if indent >= skip_at:
                continue                  # inside an "Initial Plan" block (AQE keeps both)
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = indent
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]|\[id=#\d+\]", "", line)
        keep.append(line[:150])
    return "\n".join(keep)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    from lanescope.plans.registry import QUERIES
    from lanescope.session import local_session
    spark = local_session(8, 8)
    for name in args:
        print(f"### {name}\n```\n{tree(QUERIES[name](spark, sf_dir))}\n```\n")


if __name__ == "__main__":
    main()
