"""Print the physical-plan facts that matter at scale for registered queries:
scans (pushed filters, read schema), exchanges, broadcasts, joins, windows."""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERN = re.compile(r"^\(\d+\) (Scan parquet|Exchange|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|"
                     r"Window|HashAggregate|ObjectHashAggregate|SortAggregate|Generate|BroadcastNestedLoopJoin|"
                     r"CartesianProduct|Expand|InMemoryTableScan)")


def main():
    from caresignal.plans import QUERIES
    from caresignal.session import local_session
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    for k in sys.argv[1:]:
        df = QUERIES[k](spark, sf)
        text = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        ops, scans = {}, []
        lines = text.splitlines()
        for i, line in enumerate(lines):
            m = PATTERN.match(line)
            if m:
                ops[m.group(1)] = ops.get(m.group(1), 0) + 1
            if line.startswith("ReadSchema:") or line.startswith("PushedFilters:"):
                scans.append(line.strip())
            if line.startswith("Arguments: hashpartitioning") or line.startswith("Arguments: rangepartitioning"):
                scans.append("  " + line.strip()[:140])
        print(f"== {k}: {dict(sorted(ops.items()))}")
        for s in scans:
            print("   ", s[:160])


if __name__ == "__main__":
    main()
