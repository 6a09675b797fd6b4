"""Execute every registered query and summarise its final (adaptive) physical plan.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from centwise.plans.queries import QUERIES  # noqa: E402
from centwise.session import build_session  # noqa: E402

COUNTS = [
    ("shuffles", r"Exchange (?:hashpartitioning|RoundRobinPartitioning|rangepartitioning|SinglePartition)"),
    ("reused", r"ReusedExchange"),
    ("bcast_join", r"BroadcastHashJoin"),
    ("smj", r"SortMergeJoin"),
    ("shj", r"ShuffledHashJoin"),
    ("partial_agg", r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_|ObjectHashAggregate\(keys=\[[^\]]*\], functions=\[partial_"),
    ("window_limit", r"WindowGroupLimit"),
    ("python", r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandasWithState"),
    ("cartesian", r"CartesianProduct|BroadcastNestedLoopJoin"),
]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    print(f"# Physical plans at {os.path.basename(sf)}\n")
    print("Generated by `tools/plan_report.py`. Each query runs, then its final adaptive plan is searched (not")
    print("the plans of intermediates that it wrote before).")
    print("Counts are node occurrences in the printed plan tree: a subtree that two branches share is printed")
    print("(and counted) once per branch even when AQE reuses its exchange (`reused`). `partial_agg` counts")
    print("map-side aggregates before a shuffle, `window_limit` counts `WindowGroupLimit` (top-k trimmed before")
    print("the shuffle), and `python` counts pandas operators. `cartesian` must stay 0. The last column lists")
    print("filters pushed into parquet scans, apart from null checks.\n")
    print("| query | " + " | ".join(n for n, _ in COUNTS) + " | pushed filters |")
    print("|---|" + "---|" * (len(COUNTS) + 1))
    for name in QUERIES:
        df = QUERIES[name](spark, sf)
        df.collect()
        final = df._jdf.queryExecution().executedPlan()
        if final.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            final = final.executedPlan()           # the plan that ran, without the initial one
        plan = final.toString()
        counts = [str(len(re.findall(p, plan))) for _, p in COUNTS]
        pushed = set(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan))
        pushed = [", ".join(x for x in re.split(r", (?=[A-Z])", p) if x and not x.startswith("IsNotNull"))
                  for p in sorted(pushed)]
        pushed = [p for p in pushed if p]
        print(f"| {name} | " + " | ".join(counts) + " | " + ("; ".join(pushed) or "-") + " |")
    spark.stop()


if __name__ == "__main__":
    main()
