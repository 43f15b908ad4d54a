"""Write the final (post-AQE) physical plans of selected queries to a markdown file:

    python -m rivulet.plans.explain /root/testdata/sf0.1 PLANS.md
"""

from __future__ import annotations

import re
import sys

# Query -> what its plan shows.
SHOWCASE = {
    "error_lists": "keyed scan: one shuffle on (stream, time bucket); the summary reuses it "
                   "(ReusedExchange) and only the small summary joins back",
    "errors_keep_last_dense": "top-100 per stream: partial WindowGroupLimit before the "
                              "exchange, so each hot stream ships at most 100 rows per partition",
    "streams_create": "first-wins per channel as a partial aggregate (min over a struct)",
    "lease_conflicts": "one exchange and sort by (channel, segment), one pass of Arrow batches; "
                       "the joins add the cuts and the segments' first states, both small",
    "start_position": "only doc_id and source are read (the text column is pruned); the "
                      "join side is chosen by measured size",
    "circuit_timeline": "one exchange and sort by (stream, segment), one pass of Arrow batches",
    "table_lookup": "bucketed registry, planned as too large to broadcast: no Exchange on its side",
    "table_skip": "bucketed checkpoint table, planned as too large to broadcast: no Exchange on its side",
}

LARGE = {"table_lookup", "table_skip"}  # planned as if their tables were too large to broadcast


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.toRdd().count()                       # runs this plan on the JVM side (no rows to Python)
    text = qe.executedPlan().toString().split("+- == Initial Plan ==")[0]
    text = re.sub(r"#\d+L?", "", text)                      # expression ids
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    text = re.sub(r"Location: [^,]+, ", "", text)
    return "\n".join(line[:160] for line in text.splitlines())


def main(argv):
    from rivulet.plans.catalog import QUERIES
    from rivulet.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    out = argv[2] if len(argv) > 2 else "PLANS.md"
    spark = get_session("local[8]", shuffle_partitions=8)
    parts = ["# Physical plans\n",
             f"Final plans after adaptive execution, `{sf_dir}`, `local[8]`, 8 shuffle "
             "partitions. Generated by `python -m rivulet.plans.explain`; expression ids "
             "and file locations removed.\n"]
    for name, note in SHOWCASE.items():
        # The fixtures' tables are small enough to broadcast; large ones are joined by bucket.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if name in LARGE else "10m")
        parts.append(f"## `{name}`\n\n{note}.\n\n```\n{final_plan(QUERIES[name](spark, sf_dir))}\n```\n")
    with open(out, "w") as f:
        f.write("\n".join(parts))
    print(f"wrote {out}")


if __name__ == "__main__":
    main(sys.argv)
