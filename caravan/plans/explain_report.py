"""Physical-plan report of every registered query.

Runs each query (collecting its own DataFrame, so the final adaptive plan is
available) and counts the operators that matter at scale: shuffles, join
strategies, partial aggregation, bounded windows, Python stages, and shapes
that must never appear (cartesian / nested-loop joins, row-at-a-time Python
UDFs). Writes a markdown table.

usage: python -m caravan.plans.explain_report [sf_dir] [out.md]
"""

from __future__ import annotations

import re
import sys

FEATURES = [
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|"
                 r"Exchange RoundRobinPartitioning"),
    ("broadcasts", r"BroadcastExchange"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"SortMergeJoin"),
    ("SHJ", r"ShuffledHashJoin"),
    ("partial aggs", r"partial_"),
    ("WindowGroupLimit", r"WindowGroupLimit"),
    ("windows", r"\bWindow \["),
    ("top-k", r"TakeOrderedAndProject"),
    ("python", r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|FlatMapGroupsInPandasWithState"),
    ("row UDF", r"BatchEvalPython"),
    ("cartesian/NLJ", r"CartesianProduct|BroadcastNestedLoopJoin"),
]


def final_plan(plan: str) -> str:
    """The adaptive plan's final part (its text also holds the initial plan)."""
    return plan.split("== Initial Plan ==")[0]


def plan_features(plan: str) -> dict[str, int]:
    plan = final_plan(plan)
    return {name: len(re.findall(rx, plan)) for name, rx in FEATURES}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    from caravan.plans.registry import QUERIES, _load_all
    from caravan.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    _load_all()
    head = "| query | " + " | ".join(n for n, _ in FEATURES) + " |"
    sep = "| --- | " + " | ".join("---" for _ in FEATURES) + " |"
    text = (f"# Physical plans of the registered queries ({sf})\n\n"
            "Final adaptive plans, counted by `python -m caravan.plans.explain_report`. "
            "`shuffles` = hash / range exchanges; `partial aggs` = map-side partial aggregate "
            "functions; `WindowGroupLimit` = per-task top-k before a window's shuffle; `python` = "
            "Arrow-batched pandas stages (only M6 admission); `row UDF` and `cartesian/NLJ` must be 0.\n")
    bad = set()
    for title, threshold in (("As run here (small tables are broadcast)", None),
                             ("Without broadcast joins, as with tables too large for them", "-1")):
        if threshold:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
        text += f"\n## {title}\n\n{head}\n{sep}\n"
        for name in sorted(QUERIES):
            df = QUERIES[name][0](spark, sf)
            df.collect()
            f = plan_features(df._jdf.queryExecution().executedPlan().toString())
            if f["row UDF"] or f["cartesian/NLJ"]:
                bad.add(name)
            text += "| `%s` | " % name + " | ".join(str(f[k]) for k, _ in FEATURES) + " |\n"
    text += "\n" + (f"Queries with forbidden shapes: {sorted(bad)}\n" if bad else
                    "No query has a row-at-a-time UDF, a cartesian product or a nested-loop join.\n")
    with open(out, "w") as fh:
        fh.write(text)
    print(f"wrote {out}: {len(QUERIES)} queries, forbidden shapes in {len(bad)}")


if __name__ == "__main__":
    main()
