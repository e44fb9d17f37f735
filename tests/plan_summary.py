"""Write PLANS.md: for every registered query, the exchanges and scans of its physical plan.

usage: python tests/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"train_and_score", "retrain_after_toggle", "feature_importance", "holdout_metrics", "stream_import",
        "stream_engagement", "stream_trend"}


def summarise(plan: str) -> dict:
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcast": len(re.findall(r"BroadcastExchange|Exchange HashedRelationBroadcastMode|Exchange IdentityBroadcastMode", plan)),
        "scans": len(re.findall(r"FileScan ", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "bhj": len(re.findall(r"BroadcastHashJoin", plan)),
        "python": len(re.findall(r"MapInPandas|PythonMapInArrow|ArrowEvalPython|BatchEvalPython", plan)),
        "topk": len(re.findall(r"TakeOrderedAndProject", plan)),
    }


def main(argv):
    from ebbtide.session import build_session
    import __spark_entry__ as entry
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan, before runtime re-planning
    # as if every table were large: only the explicit, size-checked broadcasts remain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `tests/plan_summary.py` on `{sf}` with AQE off and automatic broadcasts off, i.e. the",
             "plans Spark picks when every table is large: the only broadcasts left are the explicit ones behind a",
             "size check (source registry, geography, templates) or a proven bound (per-partition offsets). At run",
             "time AQE may still coalesce partitions or broadcast a side it measures small.",
             "Stream and model-training queries are omitted (their plans are per micro-batch / per epoch).", "",
             "Columns: shuffle exchanges by partitioning (hash / range / single partition), broadcast exchanges,",
             "file scans, sort-merge and broadcast-hash joins, Python stages, top-k operators.", "",
             "| query | hash | range | single | broadcast | scans | SMJ | BHJ | python | top-k |",
             "|---|---|---|---|---|---|---|---|---|---|"]
    for name, fn in entry.queries().items():
        if name in SKIP:
            continue
        p = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summarise(p)
        lines.append(f"| {name} | " + " | ".join(str(s[k]) for k in
                     ("hash", "range", "single", "broadcast", "scans", "smj", "bhj", "python", "topk")) + " |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(out)


if __name__ == "__main__":
    main(sys.argv)
