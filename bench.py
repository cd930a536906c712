"""Times the headline queries on the given tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tallywatch.plans.registry import QUERIES, trained_models  # noqa: E402
from tallywatch.session import build_session  # noqa: E402
from tallywatch.sources.star import transactions_table  # noqa: E402

HEADLINE = [
    "rules_v3",
    "rules_v2",
    "feature_matrix",
    "feat_velocity",
    "kpis",
    "trend_daily",
    "trend_weekly",
    "trend_monthly",
    "histogram",
    "level_summary",
    "merchant_rollup",
    "country_rollup",
    "customer_profile",
    "customer_history",
    "network_edges",
    "network_nodes",
    "sar_candidates",
    "sar_facts",
    "alerts_after_actions",
    "alerts_listing",
    "attribution_penalty",
    "stream_scoring",
    "stream_velocity",
    "forest_scores",
]


def materialise(df) -> None:
    """Computes every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    materialise(QUERIES["kpis"](spark, folder))  # warm-up: class loading and code generation

    timings = {}
    for name in chosen:
        start = time.perf_counter()
        materialise(QUERIES[name](spark, folder))
        timings[name] = round(time.perf_counter() - start, 3)
    if not sys.argv[1:]:
        start = time.perf_counter()
        trained_models(spark, folder)
        timings["train_models"] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        materialise(QUERIES["hybrid_scores"](spark, folder))
        timings["hybrid_scores"] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_query_time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "rows": transactions_table(spark, folder).count(),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
