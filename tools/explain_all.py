"""Summarise the physical plan of every registered query (or print one in full).

Usage: python tools/explain_all.py [sf_dir] [query]   (with a query name: full formatted plan)
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsdeck.registry import QUERIES  # noqa: E402
from opsdeck.session import build_session  # noqa: E402

NODES = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "HashAggregate",
         "SortAggregate", "ObjectHashAggregate", "Generate", "TakeOrderedAndProject", "Sort", "Window")


def plan_text(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    if len(sys.argv) > 2:
        print(plan_text(QUERIES[sys.argv[2]](spark, sf_dir)))
        return
    for name, fn in QUERIES.items():
        text = plan_text(fn(spark, sf_dir))
        head = text.split("\n\n\n")[0]
        counts = Counter()
        for node in NODES:
            counts[node] = len(re.findall(rf"[ *+-]{re.escape(node)} \(", head))
        scans = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
        pushed = [p for p in re.findall(r"PushedFilters: (\[.*?\])", text) if p != "[]"]
        summary = ", ".join(f"{k}={v}" for k, v in counts.items() if v)
        print(f"{name:26s} {summary}")
        for s in scans:
            print(f"{'':26s}   read {s[:110]}")
        for p in pushed:
            print(f"{'':26s}   pushed {p[:110]}")


if __name__ == "__main__":
    main()
