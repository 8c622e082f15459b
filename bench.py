"""Times the headline queries and prints one JSON line.

Each query runs into the ``noop`` sink, so every row is built and none is stored. The checks on the
data folder (size of the rate table, heavy keys) run once per folder and are timed as ``plan_checks``.
"""

from __future__ import annotations

import json
import os
import time

from ledgermatch.fixtures import PROFILES
from ledgermatch.registry import QUERIES, recipe
from ledgermatch.session import local_session

HEADLINE = (
    "fx_asof_valuation", "dup_rank", "pairs_id_base", "pairs_id_fx", "pairs_id_own", "pairs_journal", "pairs_keyless",
    "causes_id_fx", "pairs_all", "summary_by_cause", "summary_by_psp", "totals_identity", "restatement",
    "restated_revenue", "fee_check", "profile_columns", "profile_values", "capture_delay_stats", "describe_by_group",
    "revenue_share", "dq_not_null", "dq_fee_lines", "dq_tie_out",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    data = recipe(spark, sf_dir)
    timed("plan_checks", lambda: (data.book, data.heavy(*PROFILES)))
    for name in (*HEADLINE, *(q for q in QUERIES if q not in HEADLINE)):
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                # the sum over the same queries each round; all others are timed beside them
                "value": round(sum(seconds[n] for n in ("plan_checks", *HEADLINE)), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
