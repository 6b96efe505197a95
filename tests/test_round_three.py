"""Ball tree, hash tree of the log, Poisson resampling, mergeable quantiles, pruned reads, restart of a sink."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import audit, components, cosine, pairs, prep, timelines
from cohort.session import written
from cohort.sources import images, logs
from cohort.streaming import feeds


@pytest.fixture(scope="module")
def log(spark):
    rows = [(f"e{i:03}", 1_704_067_200 + 240 * i, f"a{i % 3}") for i in range(120)]
    return spark.createDataFrame(rows, "event_id string, s bigint, actor string").select(
        "event_id", F.timestamp_seconds("s").alias("timestamp"), "actor")


def names(frame):
    return sorted(r.event_id for r in frame.select("event_id").collect())


def faults(log, roots):
    return sorted((r.chunk.hour + 24 * (r.chunk.day - 1), r.n, r.found, r.fault)
                  for r in audit.broken_chunks(log, roots, "k").collect())


def test_hash_tree_locates_what_was_done_to_a_log(spark, log):
    kept = audit.linked(log, "k").cache()
    roots = audit.chunk_roots(kept, "k").cache()
    assert names(audit.broken_links(kept, "k")) == [] and faults(kept, roots) == []
    assert roots.count() == 8
    gone = kept.where("event_id <> 'e020'")
    assert names(audit.broken_links(gone, "k")) == ["e021"]
    assert faults(gone, roots) == [(1, 15, 14, "missing")]
    last = kept.where("event_id <> 'e029'")  # no successor in its hour: only the root shows it
    assert names(audit.broken_links(last, "k")) == []
    assert faults(last, roots) == [(1, 15, 14, "missing")]
    moved = kept.withColumn("timestamp", F.when(F.col("event_id") == "e020", F.col("timestamp")
                                                + F.expr("INTERVAL 10 MINUTES"))
                            .otherwise(F.col("timestamp")))
    assert names(audit.broken_links(moved, "k")) == ["e020", "e021", "e023"]
    other = kept.withColumn("actor", F.when(F.col("event_id") == "e050", "x").otherwise(
        F.col("actor")))
    assert names(audit.broken_links(other, "k")) == ["e050"]
    # one who knows no key puts the link of another event there: the root shows it
    forged = other.withColumn("link", F.when(F.col("event_id") == "e050", F.lit("0" * 64))
                              .otherwise(F.col("link")))
    assert faults(forged, roots) == [(3, 15, 15, "changed")]
    added = kept.union(kept.where("event_id = 'e100'").withColumn("event_id", F.lit("zzz")))
    assert faults(added, roots) == [(6, 15, 16, "added")]
    # a whole hour is taken out of log and roots alike
    hour = F.hour("timestamp") != 4
    assert faults(kept.where(hour), roots.where(F.hour("chunk") != 4)) == [(5, 15, 15, "chain")]
    assert faults(kept.limit(0), roots.limit(0)) == []


def test_poisson_counts(spark):
    for mean in (0.01, 1.0, 7.9):
        cuts = prep.poisson_cuts(mean)
        assert cuts[0] == math.exp(-mean) and cuts[-1] == pytest.approx(1)
        assert all(a <= b for a, b in zip(cuts, cuts[1:]))
    rows = [(i, "a" if i < 3000 else "b" if i < 3300 else "c") for i in range(3310)]
    frame = spark.createDataFrame(rows, "id bigint, label string").repartition(3)
    drawn = prep.poisson_resample(frame, "id", ["a", "b", "c", "d"]).cache()
    counts = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    share = 3310 / 3
    assert all(abs(counts[c] - share) < 5 * share ** 0.5 for c in "abc")
    per_row = [r["count"] for r in drawn.where("label = 'c'").groupBy("id").count().collect()]
    assert len(per_row) == 10 and min(per_row) > 60  # a mean of 110 from several draws
    again = prep.poisson_resample(frame.repartition(7), "id", ["a", "b", "c", "d"])
    assert sorted(again.collect()) == sorted(drawn.collect())
    copies = drawn.groupBy("id").agg(F.count("*").alias("n"), F.max("copy").alias("top"))
    assert copies.where("n <> top").isEmpty()
    assert prep.poisson_resample(frame.limit(0), "id", ["a"]).collect() == []


def test_merged_quantiles_keep_their_rank(spark):
    rng = random.Random(1)
    values = [(1_704_067_200 + rng.randrange(86_400), rng.choice("xy"), rng.lognormvariate(3, 1))
              for _ in range(20_000)]
    rows = spark.createDataFrame(values, "s bigint, class string, latency_ms double").select(
        F.timestamp_seconds("s").alias("ts"), "class", F.lit(0.5).alias("confidence"),
        "latency_ms")
    minutes = timelines.latency_sketches(rows.repartition(5), "10 minutes")
    assert minutes.count() == 288
    for r in timelines.merged_sketches(minutes, "day").collect():
        mine = sorted(v for _, c, v in values if c == r["class"])
        assert r["n"] == len(mine) and r["mean_confidence"] == 0.5
        for q, found in zip((0.5, 0.95), r["quantiles"]):
            rank = sum(v <= found for v in mine) / len(mine)
            assert abs(rank - q) < 2 * timelines.RANK_ERROR
    empty = rows.withColumn("latency_ms", F.lit(None).cast("double"))
    assert {r["quantiles"] for r in timelines.merged_sketches(
        timelines.latency_sketches(empty, "1 hour"), "day").collect()} == {None}


def test_split_folders_are_pruned(spark, tmp_path):
    place = str(tmp_path / "split")
    rows = spark.range(60).select("id", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))),
                                                     (F.col("id") % 3 + 1).cast("int"))
                                  .alias("split"), (F.col("id") % 5).cast("string").alias("label"))
    images.write_split(rows, place)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    val = images.read_split(spark, place, ["val"], ["1", "2"])
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "DataFilters: []" in plan
    assert sorted(r.id for r in val.collect()) == [
        i for i in range(60) if i % 3 == 1 and i % 5 in (1, 2)]
    wanted = written(spark.createDataFrame([("test", "3"), ("train", "0"), ("train", "9")],
                                           "split string, label string"), "wanted")
    found = images.read_split_of(spark, place, wanted)
    assert sorted(r.id for r in found.collect()) == [
        i for i in range(60) if (i % 3, i % 5) in ((2, 3), (0, 0))]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_a_sink_goes_on_where_it_was_stopped(spark, tmp_path):
    """Each event once, though the sink is stopped between batches and events come twice."""
    source, out, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    schema = "event_id string, timestamp timestamp"
    for k in range(6):  # each file repeats half of the one before
        rows = [(f"e{i}", 1_704_067_200 + 10 * i) for i in range(10 * k, 10 * k + 15)]
        spark.createDataFrame(rows, "event_id string, s bigint").select(
            "event_id", F.timestamp_seconds("s").alias("timestamp")).coalesce(1).write.mode(
            "append").parquet(source)
        time.sleep(0.05)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = (feeds.deduplicated(events).writeStream.format("json").outputMode("append")
            .option("timestampFormat", logs.EVENT_TIME).option("path", out)
            .option("checkpointLocation", progress).trigger(processingTime="0 seconds").start())
    while not sink.lastProgress or sink.lastProgress["batchId"] < 1:
        time.sleep(0.1)
    sink.stop()
    done = logs.read_events(spark, out).count()
    feeds.audit_sink(events, out, progress).awaitTermination()
    names_ = [r.event_id for r in logs.read_events(spark, out).collect()]
    assert sorted(names_) == sorted(f"e{i}" for i in range(65)) and 0 < done


def test_access_lines_with_odd_signs_and_values(spark):
    from cohort.sources.logs import parse_access_lines, rejected_access_lines

    def line(request="GET / HTTP/1.1", at="10/Oct/2025:13:55:36 +0000", size="12", rt="0.1", agent="x"):
        return f'10.0.0.1 - - [{at}] "{request}" 200 {size} "-" "{agent}" rt={rt}'

    good = [line(), line(request="GET /\u0001a"), line(agent="\u0001")]
    bad = [line(at="31/Feb/2025:13:55:36 +0000"), line(size="9" * 30), line(rt="1.2.3"),
           "\u0001" * 8, line() + "\u0001", "", None]
    lines = spark.createDataFrame([(x,) for x in good + bad], "value string")
    rows = parse_access_lines(lines).collect()
    assert {(r["request"], r["user_agent"], r["bytes"]) for r in rows} == {
        ("GET / HTTP/1.1", "x", 12), ("GET /\u0001a", "x", 12), ("GET / HTTP/1.1", "\u0001", 12)}
    rejected = [r["value"] for r in rejected_access_lines(lines).collect()]
    assert sorted(map(str, rejected)) == sorted(map(str, bad))


def test_rank_by_sampled_splitters(spark):
    """A group with most rows, null groups, keys that share all leading digits, and no rows."""
    import random

    from cohort.operators.skew import global_rank

    rng = random.Random(3)
    keys = [(f"0000{rng.randrange(10**9):09d}", i, rng.choice(["a", "a", "a", "b", None]))
            for i in range(5000)]
    frame = spark.createDataFrame(keys, "k string, id bigint, g string").repartition(7)
    for within in ([], ["g"]):
        seen, want = {}, {}
        for k, i, g in sorted(keys):
            seen[g if within else 0] = want[i] = seen.get(g if within else 0, 0) + 1
        ranked = global_rank(frame, "k", "id", within, digits=1)
        assert {r["id"]: r["rank"] for r in ranked.collect()} == want
        assert ranked.columns == ["k", "id", "g", "rank"]
    assert global_rank(frame.where("id < 0"), "k", "id").collect() == []


def test_ball_tree_prunes_clusters_and_loses_nothing(spark):
    """Clustered vectors meet a small share of all pairs; a dense sub-ball is cut into blocks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    vectors = np.concatenate([np.repeat(centres, 30, axis=0), np.repeat(centres[:1], 600, axis=0)])
    vectors = vectors + rng.normal(0, 0.03, vectors.shape)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                                  "id bigint, v array<double>")
    groups = written(cosine.vector_groups(frame, "id", "v"), "vectors")
    tree = cosine.ball_tree(groups, leaf_rows=20)
    assert len(tree.pivots) == 10
    met = cosine.leaf_pairs(tree, 0.99).collect()
    compared = sum(r.size1 * r.size2 for r in met)
    n = len(vectors)
    assert compared < 0.35 * n * n / 2  # the hot cluster alone is 0.12 of all pairs
    assert len({(r.ball1, r.sub1, r.ball2, r.sub2) for r in met}) == len(met)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.99, 1))
    found = {(r.first1, r.first2) for r in cosine.cosine_pairs(
        groups, 0.99, block_rows=40).select("first1", "first2").collect()}
    assert found == set(zip(i.tolist(), j.tolist()))
    none = cosine.cosine_pairs(groups.limit(0), 0.9)
    assert none.columns == ["first1", "first2", "cosine", "pairs"] and none.count() == 0


@pytest.mark.parametrize("bucket_rows, dense_rows, most", [(2000, 64, 10), (300, 8, 16)])
def test_spanning_links_connect_what_all_pairs_connect(spark, bucket_rows, dense_rows, most):
    """A dense ball of fingerprints gives few links, all of them near, and no lost connection.

    A fingerprint has a link in the forest of each of its 4 bands (of 16 with second bands), and
    half of ``dense_rows`` pairs in a bucket that is not dense.
    """
    rng = np.random.default_rng(8)
    flips = [1 << i for i in range(64)]
    base = 0x0123456789ABCDEF
    prints = {base} | {base ^ a for a in flips} | {base ^ a ^ b for a in flips for b in flips}
    prints = sorted(prints - {base} | {int(x) for x in rng.integers(1, 1 << 62, 300)})
    chain = [int(x) for x in rng.integers(1, 1 << 62, 40)]
    prints += [x ^ 7 for x in chain] + [x ^ 63 for x in chain] + chain
    rows = [(f"p{i:04}", "ab"[i % 2], f"{x:016x}") for i, x in enumerate(prints)]
    frame = spark.createDataFrame(rows, "path string, label string, print string")
    groups = written(pairs.print_groups(frame, "path", ["label"]), "groups")
    links = written(pairs.spanning_links(groups, 3, 64, bucket_rows=bucket_rows,
                                           dense_rows=dense_rows), "links")
    found = {(r.first1, r.first2): r.distance for r in links.collect()}
    value = {name: np.uint64(int(x, 16)) for name, _, x in rows}
    label = {name: x for name, x, _ in rows}
    assert all(label[a] == label[b] and np.bitwise_count(value[a] ^ value[b]) == d <= 3
               for (a, b), d in found.items())
    codes, near = np.array([value[r[0]] for r in rows]), 0
    names, root = [r[0] for r in rows], {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, name in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= 3):
            if label[names[j]] == label[name]:
                near += 1
                a, b = top(name), top(names[j])
                root[max(a, b)] = min(a, b)
    expected = {name: top(name) for name in names if any(name in p for p in found)}
    parts = {r.node: r.component for r in components.connected_components(
        links, "first1", "first2").collect()}
    assert parts == expected
    assert {n for n in names if top(n) != n} <= set(parts)
    assert near > 50 * len(prints) and links.count() <= most * len(prints)
