"""Connected components of a duplicate graph and the tables that describe clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohort.operators.skew import HOT_ROWS, join_groups
from cohort.session import written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, source: str = "path1", target: str = "path2",
                         hot_rows: int = HOT_ROWS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each round merges every node into the neighbour (or itself) with the lowest random
    priority and drops what became a loop or a repeat.  At least half of the nodes that still
    have neighbours are expected to vanish per round, so the work shrinks geometrically; the
    order of the names does not matter because priorities are hashes.
    """
    both = F.explode(F.array(F.struct(F.col(source).alias("u"), F.col(target).alias("v")),
                             F.struct(F.col(target).alias("u"), F.col(source).alias("v"))))
    links = (edges.where(F.col(source) != F.col(target))
             .select(both.alias("e")).select("e.u", "e.v").distinct())
    links = written(links, "links")
    merges = []
    while not links.isEmpty():
        if len(merges) == max_rounds:
            raise RuntimeError(f"components not closed after {max_rounds} rounds")
        merge = written(
            links.groupBy("u")
            .agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("root")))
                 .alias("best"), F.count("*").alias("n"))
            .select("u", F.least("best", F.struct(F.xxhash64("u").alias("h"),
                                                  F.col("u").alias("root")))["root"]
                    .alias("root"), "n"), "merge")
        merges.append(merge)
        half = join_groups(links, merge, ["u"], "n", hot_rows).select(
            F.col("root").alias("v"), F.col("v").alias("u"))
        moved = join_groups(half, merge, ["u"], "n", hot_rows).select(
            F.col("root").alias("u"), "v")
        links = written(moved.where(F.col("u") != F.col("v")).distinct(), "links")
    if not merges:
        return edges.select(F.col(source).alias("node"), F.col(source).alias("component")).limit(0)
    roots = merges[-1].select("u", "root")
    for merge in reversed(merges[:-1]):
        later = _with_fan_in(merge, roots, hot_rows)
        roots = written(later, "roots")
    names = roots.groupBy("root").agg(F.count("*").alias("n"), F.min("u").alias("component"))
    return join_groups(roots, names, ["root"], "n", hot_rows).select(
        F.col("u").alias("node"), "component")


def _with_fan_in(merge: DataFrame, roots: DataFrame, hot_rows: int) -> DataFrame:
    """Follow each merge to the root found later; many nodes may share one merge target."""
    step = merge.select("u", F.col("root").alias("next"))
    fan_in = step.groupBy("next").agg(F.count("*").alias("n"))
    targets = fan_in.join(roots.select(F.col("u").alias("next"), "root"), "next", "left").select(
        "next", "n", F.coalesce("root", "next").alias("root"))
    return join_groups(step, targets, ["next"], "n", hot_rows).select("u", "root")


def build_clusters(images: DataFrame, pairs: DataFrame, key: str = "path",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``cluster_id`` to images from a table of path pairs.

    Pairs with an end outside the pool are ignored; images without a pair are their own cluster.
    An end that very many pairs share is looked up once, not once per pair.
    """
    usable = pairs.where(F.col("path1") != F.col("path2")).select("path1", "path2")
    for end in ("path1", "path2"):
        ends = usable.groupBy(end).agg(F.count("*").alias("n")).join(
            images.select(F.col(key).alias(end)), end, "left_semi")
        usable = written(join_groups(usable, ends, [end], "n", hot_rows)
                         .select("path1", "path2"), "pool-pairs")
    found = connected_components(usable, hot_rows=hot_rows)
    return (images.join(found.withColumnRenamed("node", key), key, "left")
            .withColumn("cluster_id", F.coalesce("component", key)).drop("component"))


def clusters_from_prints(rows: DataFrame, groups: DataFrame, pairs: DataFrame, key: str,
                         within: Sequence[str] = ("label",),
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``first`` and ``cluster_id`` to fingerprinted rows.

    The graph has one node per print group, so copies never enter it; rows take the cluster of
    their group, and rows without a fingerprint stay alone.
    """
    within = list(within)
    edges = pairs.where(F.col("distance") > 0).select(
        F.col("first1").alias("path1"), F.col("first2").alias("path2"))
    found = connected_components(edges, hot_rows=hot_rows).withColumnRenamed("node", "first")
    placed = (groups.join(found, "first", "left")
              .select(*within, "print", "first", "n",
                      F.coalesce("component", "first").alias("cluster_id")))
    hashed = join_groups(rows.where(F.col("print").isNotNull()), placed, [*within, "print"],
                         "n", hot_rows).drop("n")
    alone = rows.where(F.col("print").isNull()).withColumns(
        {"first": F.col(key), "cluster_id": F.col(key)})
    return hashed.unionByName(alone)


def cluster_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_stats(rows: DataFrame) -> DataFrame:
    """Number of clusters, singletons and multi-member clusters, size of the largest."""
    return cluster_sizes(rows).agg(
        F.count("*").alias("clusters"),
        F.count_if(F.col("size") == 1).alias("singletons"),
        F.count_if(F.col("size") > 1).alias("multi"),
        F.max("size").alias("largest"))


def cluster_labels(rows: DataFrame, key: str) -> DataFrame:
    """Size, majority label and mixed-label flag per cluster.

    Equal counts go to the label that comes first in key order.
    """
    votes = rows.groupBy("cluster_id", "label").agg(F.count("*").alias("votes"),
                                                    F.min(key).alias("first_seen"))
    order = F.struct((-F.col("votes")).alias("v"), F.col("first_seen"))
    return votes.groupBy("cluster_id").agg(
        F.min_by("label", order).alias("cluster_label"),
        F.sum("votes").alias("size"),
        (F.count("*") > 1).alias("mixed"))


def cross_boundary(rows: DataFrame, split: str = "original_split") -> DataFrame:
    """Multi-member clusters with members on both sides of the original boundary."""
    return (rows.groupBy("cluster_id")
            .agg(F.count("*").alias("size"),
                 F.count_if(F.col(split) == "train").alias("n_train"),
                 F.count_if(F.col(split) == "test").alias("n_test"))
            .where((F.col("n_train") > 0) & (F.col("n_test") > 0)))


def size_histogram(clusters: DataFrame) -> DataFrame:
    """How many of the clusters have each size."""
    return clusters.groupBy("size").agg(F.count("*").alias("clusters"))


def largest_clusters(rows: DataFrame, clusters: DataFrame, k: int, key: str) -> DataFrame:
    """Members of the ``k`` largest clusters, with the rank of the cluster."""
    best_first = [F.desc("size"), F.col("cluster_id")]
    ranked = (clusters.select("cluster_id", "size").orderBy(*best_first).limit(k)
              .withColumn("cluster_rank", F.row_number().over(Window.orderBy(*best_first))))
    return rows.join(F.broadcast(ranked), "cluster_id")
