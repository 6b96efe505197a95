"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cohort.plans.catalogue import QUERIES
from cohort.session import build_session

HEADLINES = (
    "w11_fingerprints", "j1_exact_groups", "j2_cross_split_pairs", "j3_within_label_pairs",
    "a8_dedup_report", "j4_cosine_pairs", "g2_clusters", "g3_cluster_stats", "sp1_assignment",
    "sp4_strict_leakage", "a9_migration_matrix", "a1_class_distribution", "a2_split_by_class",
    "a5_channel_moments", "m3_confusion", "m5_per_class", "m8_auc", "m10_roc",
    "m16_model_comparison", "t2_early_stop", "w3_resample", "w5_batches", "w6_mixup",
    "d1_deidentify", "d2_keyed_hash", "d6_encrypt_roundtrip", "d9_audit_events",
    "st1_arrivals", "st3_monitor_stream", "st4_rate_breaches", "st5_flapping", "st6_sessions",
)


def warm_up(spark) -> None:
    """Start the Python workers and the shuffle, so that the first query is not charged for it."""
    ids = spark.range(0, 10_000, 1, 16).repartition(16)
    ids.mapInPandas(lambda frames: frames, "id bigint").groupBy("id").count().collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR"})
    warm_up(spark)
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of the headline queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
