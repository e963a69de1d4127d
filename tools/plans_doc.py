"""Write docs/plans.md: the formatted physical plans of the headline queries (sf0.01), executed.

Usage: python tools/plans_doc.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from explain_all import plan_text  # noqa: E402
from opsdeck.registry import QUERIES  # noqa: E402
from opsdeck.session import build_session  # noqa: E402

HEADLINE = ("endpoint_stats_files", "fleet_listing", "running_listing", "expiry_digest", "cost_by_owner",
            "nightly_plan", "extend_lifetime")


def _trim(text: str) -> str:
    # the numbered node details after the tree, without long expression dumps
    text = re.sub(r"file:[^\]\s,]+", "file:<landed>", text)
    return "\n".join(line if len(line) <= 220 else line[:217] + "..." for line in text.splitlines())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `python tools/plans_doc.py` on `{sf_dir}` after executing each query, so the",
           "adaptive plans show AQE's final choices (broadcasts, coalesced shuffles, reused exchanges)",
           "above the initial plan. Long expressions are cut at 220 characters.", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.collect()  # executes this DataFrame's own plan (a noop write would plan a new query)
        out += [f"## {name}", "", "```", _trim(plan_text(df)).strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
