"""Summarise the final (post-AQE) physical plan of every SQL-backed query.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Each query is executed once; the adaptive plan is then final, so the table
shows the join strategies and exchanges Spark actually used.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MARKERS = {
    "exchanges": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
    "broadcast joins": r"BroadcastHashJoin",
    "sort-merge joins": r"SortMergeJoin",
    "windows": r"\bWindow \[",
    "python": r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapCoGroupsInPandas|FlatMapGroupsInPandas)",
    "checkpoint reads": r"Scan ExistingRDD",
}


def final_plan(df) -> str:
    """The plan AQE finally ran (its ``executedPlan``), without the initial plan."""
    p = df._jdf.queryExecution().executedPlan()
    try:
        return p.executedPlan().toString()
    except Exception:
        return p.toString()


def summarise(plan: str) -> dict:
    out = {k: len(re.findall(v, plan)) for k, v in MARKERS.items()}
    out["pushed filters"] = "yes" if re.search(r"PushedFilters: \[[^\]]+\]", plan) else "-"
    return out


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from fitframe.session import local_session
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    q = queries()
    print(f"# Final physical plans ({os.path.basename(sf)}, local[8], AQE on)\n")
    print("Generated by `python tests/plan_report.py`.  Counts are operators in the final adaptive plan.\n")
    cols = list(MARKERS) + ["pushed filters"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in sorted(oracle_sql()):
        df = q[name](spark, sf)
        df.collect()
        plan = final_plan(df)
        s = summarise(plan)
        print(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main(sys.argv)
