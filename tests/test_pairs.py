import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.functions.bits import hamming, median_print, risk_tier, spans
from cohort.operators import cosine, pairs


def hex_of(bits):
    return np.packbits(bits).tobytes().hex()


def planted(bits, centres, copies, flips, seed=0):
    """Fingerprints around a few centres, at most ``flips`` bits away."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        centre = rng.integers(0, 2, bits).astype(np.uint8)
        for _ in range(copies):
            one = centre.copy()
            one[rng.choice(bits, rng.integers(0, flips + 1), replace=False)] ^= 1
            out.append(hex_of(one))
    return out


def distance(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def brute(prints, threshold):
    return {(a, b, distance(a, b)) for a, b in itertools.combinations(sorted(set(prints)), 2)
            if distance(a, b) <= threshold}


@pytest.mark.parametrize("bits,threshold", [(256, 8), (64, 3), (64, 8)])
@pytest.mark.parametrize("bucket_rows", [2000, 4, 1])
def test_band_join_equals_brute_force(spark, bits, threshold, bucket_rows):
    """Plain buckets, refined buckets and split buckets all give every pair exactly once."""
    prints = planted(bits, 6, 12, threshold, seed=bits + threshold)
    groups = spark.createDataFrame([(p,) for p in set(prints)], "print string")
    found = pairs.near_prints(groups, threshold, bits, bucket_rows=bucket_rows).collect()
    assert len(found) == len({(r.print1, r.print2) for r in found})
    assert {(r.print1, r.print2, r.distance) for r in found} == brute(prints, threshold)


def test_hot_band_with_a_third_of_all_rows(spark):
    """Fingerprints that share a whole band are split up, and nothing is lost."""
    rng = np.random.default_rng(5)
    rows = ["ffff" + hex_of(rng.integers(0, 2, 48).astype(np.uint8)) for _ in range(150)]
    rows += planted(64, 100, 3, 3, seed=1)
    groups = spark.createDataFrame([(p,) for p in set(rows)], "print string")
    found = pairs.near_prints(groups, 3, 64, bucket_rows=10).collect()
    assert {(r.print1, r.print2, r.distance) for r in found} == brute(rows, 3)


def test_balanced_prints_differ_in_an_even_number_of_bits(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(rng.normal(size=256).tolist(),) for _ in range(20)],
                                  "v array<double>")
    prints = [r.p for r in frame.select(median_print(F.col("v"), 256).alias("p")).collect()]
    assert all(bin(int(p, 16)).count("1") == 128 for p in prints)
    assert all(distance(a, b) % 2 == 0 for a, b in itertools.combinations(prints, 2))


def test_missing_hash_is_infinitely_far(spark):
    row = spark.createDataFrame([("0" * 64, None, "0" * 63 + "7")],
                                "a string, b string, c string").select(
        hamming(F.col("a"), F.col("b")).alias("ab"), hamming(F.col("a"), F.col("c")).alias("ac"),
        risk_tier(F.lit(0)).alias("t0"), risk_tier(F.lit(3)).alias("t3"),
        risk_tier(F.lit(4)).alias("t4")).first()
    assert row.ab == float("inf") and row.ac == 3.0
    assert (row.t0, row.t3, row.t4) == ("EXACT DUPLICATE", "HIGH RISK", "MODERATE RISK")


def test_spans_cover_everything():
    assert spans(64, 9) == [(0, 7), (7, 7), (14, 7), (21, 7), (28, 7), (35, 7), (42, 7), (49, 7),
                            (56, 8)]
    with pytest.raises(ValueError):
        spans(4, 5)


def catalog(spark, prints, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"p{i:04d}", p, str(rng.choice(["a", "b"])), str(rng.choice(["train", "test"])))
            for i, p in enumerate(prints)]
    rows.append(("p9999", None, "a", "test"))
    return spark.createDataFrame(rows, "path string, print string, label string, "
                                       "original_split string"), rows


def test_pair_counts_equal_the_full_pair_list(spark):
    """Folded pairs stand for exactly the row pairs of the nested loops, copies included."""
    prints = planted(64, 5, 8, 2, seed=9) + ["00ff00ff00ff00ff"] * 40
    frame, rows = catalog(spark, prints)
    groups = pairs.print_groups(frame, "path", ["label"])
    found = pairs.within_label_pairs(groups, 3, 64)
    counts = {r.distance: r.n for r in
              found.groupBy("distance").agg(F.sum("pairs").alias("n")).collect()}
    expected = {}
    for a, b in itertools.combinations([r for r in rows if r[1]], 2):
        d = distance(a[1], b[1])
        if a[2] == b[2] and d <= 3:
            expected[d] = expected.get(d, 0) + 1
    assert counts == expected


def test_cross_split_report(spark):
    prints = planted(64, 4, 9, 2, seed=4) + ["0f0f0f0f0f0f0f0f"] * 12
    frame, rows = catalog(spark, prints)
    cross = pairs.cross_split_pairs(pairs.side_groups(frame, "path"), 3, 64)
    report = pairs.distance_report(cross, frame, "path").collect()
    full = sorted((distance(t[1], s[1]), s[0], t[0]) for t in rows for s in rows
                  if t[1] and s[1] and t[3] == "train" and s[3] == "test"
                  and distance(t[1], s[1]) <= 3)
    for d in {x[0] for x in full}:
        of_d = [x for x in full if x[0] == d]
        shown = sorted((r.example, r.test_path, r.train_path) for r in report if r.distance == d)
        assert [x[1:] for x in shown] == [x[1:] for x in of_d[:10]]
        assert {r.pairs for r in report if r.distance == d} == {len(of_d)}


def test_exact_groups_and_totals(spark):
    frame, _ = catalog(spark, ["aa" * 8, "bb" * 8, "aa" * 8, "aa" * 8])
    group = pairs.exact_groups(frame, "path").collect()
    assert [(g.group_size, g.path1, g.path2) for g in group] == [(3, "p0000", "p0002")]
    totals = pairs.hash_totals(frame).first()
    assert tuple(totals) == (5, 4, 1, 3)


@pytest.mark.parametrize("threshold", [0.95, 0.6])
@pytest.mark.parametrize("block_rows", [2000, 7])
def test_cosine_pairs_equal_brute_force(spark, threshold, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    vectors = np.repeat(centres, 10, axis=0) + rng.normal(0, 0.12, (80, 16))
    vectors[5] = vectors[4]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                                  "id bigint, v array<double>")
    groups = cosine.vector_groups(frame, "id", "v")
    found = cosine.cosine_pairs(groups, threshold, pivots=6, block_rows=block_rows).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = [i for i in range(80) if i != 5]
    expected = {(i, j) for i, j in itertools.combinations(ids, 2) if unit[i] @ unit[j] >= threshold}
    between = [r for r in found if r.first1 != r.first2]
    assert len(between) == len(expected)
    assert {(r.first1, r.first2) for r in between} == expected
    assert all(r.pairs == (2 if 4 in (r.first1, r.first2) else 1) for r in between)
    assert [(r.first1, r.cosine, r.pairs) for r in found if r.first1 == r.first2] == [(4, 1.0, 1)]
