"""Print the physical plans of the headline queries (for plan review).

usage: python tools/explain_plans.py [sf_dir] [id ...] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from respondo.catalog import QUERIES  # noqa: E402
from respondo.session import local_session  # noqa: E402

DEFAULT = ["segment_response_rate", "describe_numeric", "roc_auc", "profit_sweep",
           "stratified_split", "factor_ranking", "one_hot_drop_first"]


def compact(plan: str) -> str:
    """Operator lines only, long attribute lists shortened."""
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if len(line) > 160:
            line = line[:157] + "..."
        out.append(line.rstrip())
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or DEFAULT
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Physical plans at {sf_dir} (after execution, AQE final plans)\n")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```\n{compact(plan)}\n```\n")


if __name__ == "__main__":
    main()
