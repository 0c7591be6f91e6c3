"""Physical-plan census of every registered query (writes PLANS.md).

For each query: shuffles (Exchange), aggregates by kind, windows, joins by
strategy, Python evaluation (none but the tree builder's MapInArrow) and the columns each scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemill.session import local_session  # noqa: E402

KINDS = ["Exchange", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "BroadcastHashJoin",
         "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Generate",
         "BatchEvalPython", "ArrowEvalPython", "MapInArrow"]


def main(sf_dir: str = "/root/testdata/sf0.01") -> None:
    from pagemill.plans.catalog import load_all, runner

    spark = local_session()
    lines = ["# Physical plans (initial AQE plans at sf0.01, `tools/plans.py`)", "",
             "| query | " + " | ".join(k.replace("Aggregate", "Agg") for k in KINDS) + " | scans (columns read) |",
             "| --- | " + " | ".join("---" for _ in KINDS) + " | --- |"]
    for name in sorted(load_all()):
        plan = runner(name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(rf"\b{k}\b", plan))) for k in KINDS]
        scans = sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan)))
        lines.append(f"| {name} | " + " | ".join(counts) + " | " + "; ".join(s.replace("#", "") for s in scans)[:300] + " |")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
