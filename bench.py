"""Times the headline queries once each and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("norm_documents", "token_stats", "length_histogram", "exact_body_duplicates", "simhash_fingerprints", "anomalies", "clean_documents", "chunk_fixed_windows", "article_units", "bm25_topk", "dense_tfidf_topk", "vector_topk", "heuristic_rerank", "retrieval_metrics", "generation_metrics")


def main() -> None:
    from pyspark.sql import SparkSession

    from corpusloom.plans.catalogue import QUERIES

    conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(2 * int(CPUS)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
