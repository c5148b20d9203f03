"""Write PLANS.md: physical-plan facts of the headline queries (sf0.01).

For each query: number of shuffle exchanges, join strategies, partial
aggregations / group limits, and the pruned scan schemas."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from pagelake.plans.registry import QUERIES  # noqa: E402
from pagelake.session import get_spark  # noqa: E402


def facts(plan: str) -> dict:
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                                    plan)),
        "broadcast joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "nested-loop joins": plan.count("NestedLoopJoin"),
        "partial aggregates": len(re.findall(r"partial_", plan)),
        "partial group limits": plan.count("WindowGroupLimit") // 2,
        "python (Arrow) stages": len(re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas", plan)),
        "scans": scans,
    }


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark()
    out = ["# PLANS — physical-plan facts of the headline queries", "",
           f"Generated by `scripts/explain_plans.py` on `{sf}` (AQE initial plans; AQE may still switch a "
           "sort-merge join to a broadcast at run time when a side turns out small).", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        f = facts(plan)
        out.append(f"## {name}")
        out.append("")
        for k, v in f.items():
            if k == "scans":
                for s in v:
                    out.append(f"- scan `{s[:160]}`")
            else:
                out.append(f"- {k}: {v}")
        out.append("")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
