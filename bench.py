"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sessionloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "session_basic_features",
    "session_rich_features",
    "session_advanced_features",
    "session_behavior_features",
    "rows_with_group_counts",
    "event_rows_with_history",
    "frequency_session_stats",
    "basket_features",
    "label_codes",
    "iqr_filter",
    "describe_value",
    "corr_long",
    "standard_scale",
    "text_normalize_b",
    "word_counts",
    "gazetteer_resolve",
    "money_parse",
    "tfidf_documents",
    "cosine_pairs",
    "session_embedding_mean",
    "ensemble_weighted",
    "prediction_repair",
    "csv_roundtrip",
    "lr_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sessionloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark.read.parquet(f"{folder}/events.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
