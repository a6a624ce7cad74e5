"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillflow.queries import QUERIES  # noqa: E402
from tillflow.session import get_session  # noqa: E402

HEADLINE = [
    "sales_summary",
    "daily_sales",
    "regional_sales",
    "product_performance",
    "customer_value",
    "executive_kpis",
    "order_revenue",
    "grain_violations",
    "join_star_lookup",
    "dedup_by_key",
    "silver_orders",
    "silver_items",
    "dq_metrics",
    "fact_sales",
    "fact_metrics",
    "scd2_history",
    "resample_monthly",
    "forecast_linear",
    "half_split_growth",
    "pareto_share",
    "rfm_tiers",
    "basket_pairs",
    "profile_columns",
    "profile_outliers",
    "quality_score",
    "clean_recipe",
    "semantic_types",
    "kpi_row",
    "record_diff",
    "rollup_time",
    "sliding_batch",
    "stream_foreach_batch",
    "burst_detect",
    "rate_limit_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "tillflow-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["order_revenue"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for key in HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[key] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
