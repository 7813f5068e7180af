"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["src_01_read_events", "prj_08_to_query_events", "prj_09_to_product_events", "prj_10_to_purchase_events", "joi_03_attribute",
            "agg_01_store_funnel", "agg_06_query_funnel", "cls_01_classify_leaks", "agg_12_chosen_products", "agg_14_query_baseline",
            "agg_19_daily_activity", "agg_31_rollout_report", "agg_32_co_cart_pairs", "cat_01_apply_feed", "sch_01_document_postings",
            "sch_06_retrieve", "sch_14_vector_rank", "scr_06_page_links", "evd_02_validate_facts"]


def main() -> None:
    from storelens.plans import demo, load_all
    from storelens.plans.registry import QUERIES
    from storelens.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("storelens-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    QUERIES["prj_08_to_query_events"](spark, sf).count()  # JVM and Python workers warm
    QUERIES["scr_01_visible_text"](spark, sf).limit(1).collect()
    took = {}
    for name in HEADLINE:
        demo.reset(spark)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    rows = demo.table(spark, sf, "events").count()
    load = sum(took[n] for n in HEADLINE[1:4])
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf).removeprefix("sf"), "events": rows, "normalised_events_per_sec": round(rows / load)}))
    spark.stop()


if __name__ == "__main__":
    main()
