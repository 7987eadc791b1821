"""Headline timings: python bench.py prints one JSON line.

Every query runs once to warm up, then three times to a no-op sink; the median counts.
BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores, BENCH_RUNS the repeats.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modsift.plans.catalog import QUERIES  # noqa: E402
from modsift.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_source_quality", "x14_process_texts", "c1_clean_text", "n1_tokenize", "x1_statistical_features",
    "x8_tfidf", "x9_idf_table", "x11_ngrams", "a15_vocabulary_build", "u1_upsert_vocabulary",
    "j1_dedup_exact", "j2_dedup_cleaned_report", "j7_similarity_of_pairs", "j9_similar_by_feature_overlap",
    "a9_request_statistics", "a12_latency_profile", "a18_metric_summary", "l5_retain_latest", "u2_apply_status_events",
    "d1_split_dataset_exact", "d2_feature_statistics", "e2_auc_roc", "e4_silhouette", "e10_best_epoch",
    "q9_collection_rules", "m8_dbscan", "i1_predict", "j8_near_duplicate_clusters", "j7_similarity_join", "j9_similar_to_targets", "m8_dbscan_vectors", "e7_bootstrap_ci", "i4_detect_anomaly", "i5_audit_texts", "w5_windowed_error_rate", "w6_windowed_p95", "s7_page_texts", "g1_augment",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    docs, text_mb = documents.selectExpr("count(*)", "sum(octet_length(text)) / 1e6").first()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    result = {
        "metric": "total_seconds_of_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "records_per_second": {
            n: round(docs / times[n], 1) for n in ("x14_process_texts", "c1_clean_text", "flagship_source_quality") if n in times
        },
    }
    result["text_mb_per_second"] = {n: round(float(text_mb) / times[n], 2) for n in result["records_per_second"] | {"x8_tfidf": 0, "x11_ngrams": 0, "j1_dedup_exact": 0} if n in times}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
