"""Headline queries, one JSON line: seconds per query and products tagged per second."""
from __future__ import annotations

import json
import os
import time

from tagloom.plans import load
from tagloom.session import local_session

HEADLINE = [
    "rule_tags", "tagging_by_category_and_tier", "detected_categories", "controlled_tagging", "validate_tags",
    "variant_export", "sku_lookup", "consolidated_products", "merged_tiers", "catalog_diff", "tag_diff",
    "contribution", "similar_groups", "common_tags", "balanced_sample", "prediction_evaluation",
    "selected_assets", "exact_duplicates", "catalog", "similar_images", "near_duplicates", "equal_name_matches",
    "page_metadata", "health_history", "trailing_rate", "registry_state_strict", "model_cascade",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "tagloom-bench")
    queries = load().QUERIES
    queries["store_stats"](spark, sf).collect()  # start-up is not a query's cost
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    products = spark.read.parquet(f"{sf}/part.parquet").count()
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "products_tagged_per_second": round(products / seconds["rule_tags"], 1)}))


if __name__ == "__main__":
    main()
