import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import components, migration, splits
from cohort.operators.skew import global_rank, join_groups, running_max


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edges_frame(spark, edges):
    return spark.createDataFrame(edges, "path1 string, path2 string")


@pytest.mark.parametrize("kind", ["random", "chain", "star", "ring"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_components(spark, kind, hot_rows):
    random.seed(4)
    names = [f"n{i:03d}" for i in range(60)]
    edges = {"random": [tuple(random.sample(names, 2)) for _ in range(45)],
             "chain": list(zip(names, names[1:])),
             "star": [(names[30], n) for n in names if n != names[30]],
             "ring": list(zip(names, names[1:] + names[:1]))}[kind]
    found = components.connected_components(edges_frame(spark, edges), hot_rows=hot_rows)
    touched = {n for e in edges for n in e}
    assert {r.node: r.component for r in found.collect()} == roots_of(touched, edges)


def test_too_many_rounds_is_an_error(spark):
    with pytest.raises(RuntimeError):
        components.connected_components(edges_frame(spark, [("a", "b"), ("b", "c")]),
                                        max_rounds=0)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_clusters_of_a_pool(spark, hot_rows):
    """Pairs that leave the pool are ignored; everyone else is alone."""
    pool = spark.createDataFrame([(c,) for c in "abcde"], "path string")
    pairs = spark.createDataFrame([("a", "b", 0), ("b", "c", 4), ("d", "not_in_pool", 2)],
                                  "path1 string, path2 string, distance int")
    rows = components.build_clusters(pool, pairs, hot_rows=hot_rows)
    assert {r.path: r.cluster_id for r in rows.collect()} == dict(zip("abcde", "aaade"))
    assert tuple(components.cluster_stats(rows).first()) == (3, 2, 1, 3)
    none = components.build_clusters(pool, pairs.limit(0))
    assert all(r.path == r.cluster_id for r in none.collect())


def test_majority_label_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([("c1", "b1", "x"), ("c1", "a2", "y"), ("c2", "z", "x")],
                                 "cluster_id string, path string, label string")
    found = {r.cluster_id: (r.cluster_label, r.size, r.mixed)
             for r in components.cluster_labels(rows, "path").collect()}
    assert found == {"c1": ("y", 2, True), "c2": ("x", 1, False)}


def naive_greedy(sizes, targets):
    current, given = [0] * 3, {}
    for size in sorted(sizes, reverse=True):
        pool = max(range(3), key=lambda p: targets[p] - current[p])
        current[pool] += size
        given.setdefault(size, [0, 0, 0])[pool] += 1
    return given


def test_quotas_equal_the_one_by_one_greedy():
    rng = random.Random(8)
    for _ in range(400):
        sizes = [rng.choice([1, 1, 1, 1, 2, 3, 5, 19]) for _ in range(rng.randint(1, 300))]
        ratios = rng.choice([(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.8, 0.2, 0.0)])
        targets = [sum(sizes) * r for r in ratios]
        current, got = [0] * 3, {}
        for size in sorted(set(sizes), reverse=True):
            got[size] = splits.run_quotas(size, sizes.count(size), targets, current)
        assert got == naive_greedy(sizes, targets)


def clustered_rows(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for cluster in range(300):
        label = "ab"[cluster % 2]
        for _ in range(int(rng.choice([1, 1, 1, 2, 3, 40], p=[.3, .3, .2, .1, .09, .01]))):
            rows.append((f"f{n:05d}", label, f"c{cluster:03d}"))
            n += 1
    return spark.createDataFrame(rows, "path string, label string, cluster_id string")


def test_split_keeps_clusters_whole_and_loses_nothing(spark):
    rows = clustered_rows(spark)
    done = splits.split_rows(rows, "path", hot_rows=30)
    again = splits.split_rows(rows.repartition(7), "path")
    assert done.count() == rows.count()
    assert sorted(done.select("path", "split").collect()) == sorted(
        again.select("path", "split").collect())
    assert splits.leaking_clusters(done).isEmpty()
    assert splits.unassigned(rows, done, "path").isEmpty()
    assert all(abs(r.deviation) < 5 for r in splits.split_counts(done).collect())
    one = components.cluster_sizes(done).where("size > 1").join(done, "cluster_id").agg(
        F.min("path").alias("path")).first().path
    leak = done.withColumn("split", F.when(F.col("path") == one, "elsewhere")
                           .otherwise(F.col("split")))
    assert splits.leaking_clusters(leak).count() == 1


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.quotas(spark.createDataFrame([("a", 1)], "cluster_label string, size bigint"),
                      (0.7, 0.2, 0.2))


def test_same_label_clusters_can_leak_across_labels(spark):
    rows = spark.createDataFrame([("a", "p", "train"), ("b", "p", "test"), ("c", "q", "val")],
                                 "path string, print string, split string")
    pairs = spark.createDataFrame([("p", "p", 0, 1), ("p", "q", 2, 2), ("q", "q", 0, 1)],
                                  "print1 string, print2 string, distance int, pairs bigint")
    found = {(r.print1, r.print2): r.pools for r in splits.leaking_pairs(rows, pairs).collect()}
    assert found == {("p", "p"): "test+train", ("p", "q"): "test+train+val"}


def test_migration_keeps_files_that_share_a_name(spark):
    original = spark.createDataFrame(
        [("a/1", "1", "x", "Training"), ("b/1", "1", "x", "Testing"), ("c/2", "2", "y", "Testing")],
        "path string, filename string, label string, original string")
    new = original.select("path").withColumn("split", F.lit("train"))
    moves = migration.migration_table(original, new)
    assert migration.overall_migration(moves).first().total == 3


def test_migration_counts(spark):
    original = spark.createDataFrame(
        [("a", "x", "Training"), ("b", "x", "Training"), ("c", "y", "Testing"),
         ("d", "y", "Testing"), ("twice", "x", "Training"), ("twice", "y", "Testing")],
        "filename string, label string, original string")
    new = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("d", "val"),
                                 ("twice", "val"), ("new", "val")],
                                "filename string, split string")
    moves = migration.migration_by_name(original, new)
    assert {(r.filename, r.original, r.new) for r in moves.collect()} == {
        ("a", "Training", "train"), ("b", "Training", "test"), ("c", "Testing", "train"),
        ("d", "Testing", "val")}
    assert [r.filename for r in migration.ambiguous_names(original).collect()] == ["twice"]
    total = migration.overall_migration(moves).first()
    assert (total.total, total.moved, total.moved_pct, total.chance_pct) == (4, 2, 50.0, 50.0)


def test_hot_groups_join_like_any_other(spark):
    rows = spark.range(100).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    plain = rows.join(groups, "k")
    assert sorted(join_groups(rows, groups, ["k"], "n", 20).collect()) == sorted(plain.collect())


def test_global_rank_and_running_max(spark):
    rows = spark.range(500).select("id", (F.col("id") % 2).alias("g"),
                                   F.md5(F.col("id").cast("string")).alias("h"))
    ranked = global_rank(rows, "h", "id", ["g"], "r", digits=1).collect()
    for g in (0, 1):
        mine = sorted((r for r in ranked if r.g == g), key=lambda r: r.h)
        assert [r.r for r in mine] == list(range(1, 251))
    chunked = running_max(rows, ["g"], "id", F.floor(F.col("id") / 50),
                          F.when(F.col("id") % 30 < 4, F.col("id")), "top").collect()
    for r in chunked:
        seen = [i for i in range(r.id + 1) if i % 2 == r.g and i % 30 < 4]
        assert r.top == (max(seen) if seen else None)
