"""Time the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from siltstone.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ("bm25_topk", "doc_frequency", "split_passages", "url_dedupe", "rrf_fuse", "html_text", "ttl_cache", "throttle_schedule", "thread_text", "html_markdown", "search_deep", "fetch_page_query", "api_parse")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
