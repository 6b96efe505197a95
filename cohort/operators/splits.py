"""Cluster-level stratified splits: whole clusters, class by class, largest first."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cohort.functions.keyed import seeded_key
from cohort.operators.components import cluster_labels
from cohort.operators.skew import HOT_ROWS, global_rank, join_groups
from cohort.session import written

POOLS = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)


def run_quotas(size: int, clusters: int, targets: Sequence[float],
               current: list[int]) -> list[int]:
    """How many of ``clusters`` equal clusters each pool gets; updates ``current``.

    Every cluster goes to the pool with the largest deficit, the first pool on a tie.  Steps
    that lie well above the common water level are taken at once, the last few one by one.
    """
    given = [0] * len(targets)
    left = clusters
    while left:
        gaps = [target - have for target, have in zip(targets, current)]
        bulk = [0] * len(gaps)
        if left > 8:
            order = sorted(gaps, reverse=True)
            for used in range(1, len(order) + 1):
                level = (sum(order[:used]) - left * size) / used
                if used == len(order) or level >= order[used]:
                    break
            bulk = [max(0, math.floor((gap - level) / size) - 1) for gap in gaps]
        if not any(bulk):
            bulk[max(range(len(gaps)), key=lambda p: gaps[p])] = 1
        for pool, steps in enumerate(bulk):
            given[pool] += steps
            current[pool] += steps * size
            left -= steps
    return given


def quotas(clusters: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Clusters of each (class, size) that go to each pool.

    The choice depends on the sizes only.  One row per distinct size reaches the task of a
    class, and a class of N rows has fewer than sqrt(2 N) distinct sizes.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")

    def assign(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("size", ascending=False)
        everything = int((runs["size"] * runs["clusters"]).sum())
        targets, current = [everything * r for r in ratios], [0] * len(ratios)
        rows = [(label, size, *run_quotas(int(size), int(n), targets, current))
                for label, size, n in zip(runs["cluster_label"], runs["size"], runs["clusters"])]
        return pd.DataFrame(rows, columns=["cluster_label", "size", "q_train", "q_val", "q_test"])

    histogram = clusters.groupBy("cluster_label", "size").agg(F.count("*").alias("clusters"))
    kind = clusters.schema["cluster_label"].dataType.simpleString()
    return histogram.groupBy("cluster_label").applyInPandas(
        assign, f"cluster_label {kind}, size bigint, q_train bigint, q_val bigint, q_test bigint")


def assign_clusters(clusters: DataFrame, ratios: Sequence[float] = RATIOS,
                    seed: int = 42) -> DataFrame:
    """Add ``split`` to clusters (cluster_id, cluster_label, size).

    Equal clusters of a class are interchangeable: a seeded hash ranks them and the quotas cut
    the ranking.
    """
    keyed = clusters.withColumn("_order", seeded_key(seed, F.col("cluster_id")))
    ranked = global_rank(keyed, "_order", "cluster_id", ["cluster_label", "size"], "_rank")
    pool = (F.when(F.col("_rank") <= F.col("q_train"), "train")
            .when(F.col("_rank") <= F.col("q_train") + F.col("q_val"), "val")
            .otherwise("test"))
    return (ranked.join(quotas(clusters, ratios), ["cluster_label", "size"])
            .withColumn("split", pool)
            .drop("_order", "_rank", "q_train", "q_val", "q_test"))


def split_rows(rows: DataFrame, key: str, ratios: Sequence[float] = RATIOS, seed: int = 42,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``split`` to rows that carry ``cluster_id`` and ``label``."""
    labelled = written(cluster_labels(rows, key), "cluster-labels")
    assigned = written(assign_clusters(labelled, ratios, seed)
                       .select("cluster_id", "size", "split"), "cluster-splits")
    return join_groups(rows, assigned, ["cluster_id"], "size", hot_rows).drop("size")


def unclustered(rows: DataFrame, key: str) -> DataFrame:
    """Without a pair table every row is its own cluster."""
    return rows.withColumn("cluster_id", F.col(key))


def split_counts(rows: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Per class and pool: rows, share of the class (percent), deviation from the target."""
    target = F.create_map(*[F.lit(x) for pair in zip(POOLS, ratios) for x in pair])
    counts = rows.groupBy("label").pivot("split", list(POOLS)).count()
    pools = F.explode(F.array(*[
        F.struct(F.lit(p).alias("split"), F.coalesce(F.col(p), F.lit(0)).alias("n"))
        for p in POOLS])).alias("pool")
    of_class = Window.partitionBy("label")
    return (counts.select("label", pools).select("label", "pool.split", "pool.n")
            .withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(of_class))
            .withColumn("deviation", F.col("pct") - target[F.col("split")] * 100.0))


def pool_summary(rows: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Per pool: rows, share of all rows, deviation; with the largest absolute deviation."""
    target = F.create_map(*[F.lit(x) for pair in zip(POOLS, ratios) for x in pair])
    everything = Window.partitionBy()
    return (rows.groupBy("split").agg(F.count("*").alias("n"))
            .withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(everything))
            .withColumn("deviation", F.col("pct") - target[F.col("split")] * 100.0)
            .withColumn("max_deviation", F.max(F.abs("deviation")).over(everything)))


def leaking_clusters(rows: DataFrame) -> DataFrame:
    """Multi-member clusters found in more than one pool."""
    return (rows.groupBy("cluster_id", "split").agg(F.count("*").alias("n"))
            .groupBy("cluster_id")
            .agg(F.sum("n").alias("size"), F.count("*").alias("pools"))
            .where((F.col("size") > 1) & (F.col("pools") > 1)))


def leaking_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of print groups whose members lie in more than one pool, whatever their label.

    Clusters that only join within a label can pass :func:`leaking_clusters` and still leak
    through a look-alike of another label; this check starts from the pair table itself.
    """
    pools = (rows.where(F.col("print").isNotNull()).select("print", "split").distinct()
             .groupBy("print")
             .agg(F.sort_array(F.collect_set("split")).alias("pools")))
    one = pools.select(F.col("print").alias("print1"), F.col("pools").alias("pools1"))
    two = pools.select(F.col("print").alias("print2"), F.col("pools").alias("pools2"))
    reached = F.sort_array(F.array_distinct(F.concat("pools1", "pools2")))
    return (pairs.join(one, "print1").join(two, "print2")
            .withColumn("pools", reached)
            .where(F.size("pools") > 1)
            .select("print1", "print2", "distance", "pairs", F.array_join("pools", "+")
                    .alias("pools")))


def unassigned(images: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Rows of the pool that no split contains."""
    return images.join(assigned.select(key), key, "left_anti")
