"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores,
``BENCH_RUNS`` the timed passes over all queries after a warm-up pass; the median per query
is reported. Results are fully computed and discarded (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stagewise.session import build_session  # noqa: E402
from workload.queries import all_queries  # noqa: E402

HEADLINE = """
q01_funnel_counts q02_user_journey q04_funnel_overlap q05_ordered_funnel q06_bot_impact
q07_funnel_by_channel q08_funnel_by_source_channel q10_search_type_performance
q11_attribution_performance q12_dma_performance q15_hourly_patterns q16_monthly_trends
q22_payment_summary q24_cleaned_orders q30_search_characteristics
q31_non_converting_searches q33_weekday_conversion q40_position_conversion
q43_sort_conversion q44_click_distribution q50_listing_stats q51_listing_segments
q54_top_listings q55_extremes
""".split()


def run(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    passes = [
        {name: run(catalog[name], spark, folder) for name in HEADLINE} for _ in range(runs + 1)]
    spark.stop()
    seconds = {
        name: round(statistics.median(p[name] for p in passes[1:]), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
