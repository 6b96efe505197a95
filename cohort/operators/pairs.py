"""Exact and near duplicates: lossless band joins over distinct fingerprints.

Rows with equal fingerprints are folded into one *print group* before any join, so a group of
copies costs one row however large it is.  Pair tables are kept at the level of print groups,
with the number of row pairs each stands for; nothing is dropped and nothing is multiplied out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohort.functions.bits import risk_tier
from cohort.operators.bands import Bands
from cohort.operators.skew import smallest
from cohort.session import written

THRESHOLD = 8
BUCKET_ROWS = 2_000
#: Fingerprints of a bucket from which it gives a spanning forest instead of its pairs.
DENSE_ROWS = 64


def print_groups(prints: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """One row per distinct fingerprint: member count and smallest key.  NULL prints are out."""
    return (prints.where(F.col("print").isNotNull())
            .groupBy(*within, "print")
            .agg(F.count("*").alias("n"), F.min(key).alias("first")))


def side_groups(prints: DataFrame, key: str, side: str = "original_split") -> DataFrame:
    """One row per distinct fingerprint with counts and smallest keys on both sides."""
    train, test = F.col(side) == "train", F.col(side) == "test"
    return (prints.where(F.col("print").isNotNull())
            .groupBy("print")
            .agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"),
                 F.min(F.when(train, F.col(key))).alias("first_train"),
                 F.min(F.when(test, F.col(key))).alias("first_test")))


def near_prints(groups: DataFrame, threshold: int = THRESHOLD, bits: int = 256,
                within: Sequence[str] = (), flags: Sequence[str] = (), wanted=None,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All pairs of distinct fingerprints at a Hamming distance of 1 to ``threshold``.

    Cut into threshold + 1 bands, two such fingerprints agree in at least one band, so an
    equi-join on (band, value) misses none; the distance is then checked exactly, and a pair is
    kept only at its first equal band, so no pair comes out twice and no ``distinct`` is needed.

    A bucket of more than ``bucket_rows`` fingerprints is not compared as it stands: the
    remaining characters are cut into threshold + 1 bands again, of which one must agree too.
    Buckets that are still large are split into blocks, and every block pair is its own join
    key.  Both steps are exact.

    ``within`` are columns that must be equal, ``flags`` small columns to carry, and
    ``wanted(left, right)`` an optional condition on them.  ``groups`` is read several times, so
    it should be a written table; its bands are cheap to cut again and are not stored.
    """
    bands = Bands(bits, threshold)
    candidates, keys, refined = _candidates(groups, bands, within, flags, bucket_rows)
    return _compared(candidates, keys, bands, refined, within, flags, wanted)


def _candidates(groups: DataFrame, bands: Bands, within: Sequence[str], flags: Sequence[str],
                bucket_rows: int) -> tuple[DataFrame, list[str], bool]:
    """Banded fingerprints in buckets of bounded size, the bucket's keys, and whether any bucket
    has a second band."""
    keys = [*within, "band", "value"]
    rows = bands.banded(groups, [*within, *flags])
    plain = {"sub": F.lit(-1), "sub_value": F.lit(0).cast("bigint"), "block": F.lit(0),
             "block_low": F.lit(0), "block_high": F.lit(0)}
    large = written(rows.groupBy(*keys).agg(F.count("*").alias("bucket_n"))
                    .where(F.col("bucket_n") > bucket_rows), "large-buckets")
    refined = False
    if large.isEmpty():
        candidates = rows.withColumns(plain)
    elif bands.can_refine:
        refined = True
        small = rows.join(large, keys, "left_anti").withColumns(plain)
        split = bands.refined(rows.join(large, keys, "left_semi"))
        candidates = small.unionByName(
            _blocked(split, [*keys, "sub", "sub_value"], bands, bucket_rows))
    else:
        whole = rows.withColumns({c: plain[c] for c in ("sub", "sub_value")})
        candidates = _blocked(whole, keys, bands, bucket_rows)
    return candidates, [*keys, "sub", "sub_value", "block_low", "block_high"], refined


def _compared(candidates: DataFrame, keys: list[str], bands: Bands, refined: bool,
              within: Sequence[str], flags: Sequence[str], wanted=None) -> DataFrame:
    """All near pairs of the buckets, each at its first equal band."""
    a, b = candidates.alias("a"), candidates.alias("b")
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    condition = condition & (bands.distance() <= bands.threshold) & bands.in_order()
    condition = condition & ((F.col("a.block") != F.col("b.block"))
                             | (F.col("a.block_low") == F.col("a.block_high")))
    if wanted is not None:
        condition = condition & wanted(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    condition = condition & bands.at_first_band(refined)
    return a.join(b, condition).select(
        *[F.col(f"a.{k}") for k in within], bands.print_hex("a").alias("print1"),
        bands.print_hex("b").alias("print2"),
        *[F.col(f"a.{c}").alias(f"{c}1") for c in flags],
        *[F.col(f"b.{c}").alias(f"{c}2") for c in flags],
        bands.distance().alias("distance"))


def _blocked(rows: DataFrame, keys: list[str], bands: Bands, bucket_rows: int) -> DataFrame:
    """Split buckets of more than ``bucket_rows`` rows into block pairs of bounded size."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("bucket_n"))
    large = written(sizes.where(F.col("bucket_n") > bucket_rows), "split-buckets")
    none = {"block": F.lit(0), "block_low": F.lit(0), "block_high": F.lit(0)}
    if large.isEmpty():
        return rows.withColumns(none)
    small = rows.join(large, keys, "left_anti").withColumns(none)
    words = [f"w{i}" for i in range(bands.words)]
    blocks = F.ceil(F.col("bucket_n") / bucket_rows).cast("int")
    split = (rows.join(large, keys)
             .withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64(*words), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("block_low", F.least("block", "other"))
             .withColumn("block_high", F.greatest("block", "other"))
             .drop("bucket_n", "blocks", "other"))
    return small.unionByName(split)


def spanning_links(groups: DataFrame, threshold: int = THRESHOLD, bits: int = 256,
                   within: Sequence[str] = ("label",), bucket_rows: int = BUCKET_ROWS,
                   dense_rows: int = DENSE_ROWS) -> DataFrame:
    """(*within, first1, first2, distance): links that connect all that near pairs connect.

    A neighbourhood of n fingerprints near each other has n * (n - 1) / 2 pairs, but n - 1 links
    connect it.  A bucket of more than ``dense_rows`` fingerprints, or a pair of its blocks, gives a
    spanning forest: every near pair shares a bucket, so the forests together connect what all pairs
    connect.  A fingerprint has about one link in each bucket that holds it: threshold + 1, the
    square of that with second bands, and one for each further block.  Smaller buckets give their
    pairs.  A link may come from several buckets; ``groups`` is a written table.
    """
    within = list(within)
    bands = Bands(bits, threshold)
    candidates, keys, refined = _candidates(groups, bands, within, ["first"], bucket_rows)
    dense = written(candidates.groupBy(*keys).agg(F.count("*").alias("bucket_n"))
                    .where(F.col("bucket_n") > dense_rows).select(*keys), "dense-buckets")
    columns = [*within, "first1", "first2", "distance"]
    if dense.isEmpty():
        return _compared(candidates, keys, bands, refined, within, ["first"]).select(*columns)
    sparse = candidates.join(dense, keys, "left_anti")
    words = [f"w{i}" for i in range(bands.words)]
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in within), f"first1 {kinds['first']}",
                        f"first2 {kinds['first']}", "distance int"])

    def forest(bucket: pd.DataFrame) -> pd.DataFrame:
        prints = bucket[words].to_numpy(np.int64).view(np.uint64)
        rest, parts = np.arange(len(prints)), []
        while len(rest):
            waiting, rest = [rest[0]], rest[1:]
            while waiting and len(rest):
                at = waiting.pop()
                away = np.bitwise_count(prints[rest] ^ prints[at]).sum(axis=1)
                near = away <= threshold
                parts.append((np.full(near.sum(), at), rest[near], away[near]))
                waiting.extend(rest[near])
                rest = rest[~near]
        one, two, away = (np.concatenate(p) for p in zip(*parts)) if parts else ([], [], [])
        names = bucket["first"].to_numpy()
        return pd.DataFrame({**{c: bucket[c].iloc[0] for c in within}, "first1": names[one],
                             "first2": names[two], "distance": away}, index=range(len(one)))

    forests = candidates.join(dense, keys, "left_semi").groupBy(*keys).applyInPandas(forest, schema)
    pairs = _compared(sparse, keys, bands, refined, within, ["first"]).select(*columns)
    return pairs.unionByName(forests)


def within_label_pairs(groups: DataFrame, threshold: int = THRESHOLD, bits: int = 256,
                       within: Sequence[str] = ("label",),
                       bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Near and exact pairs inside each label, one row per pair of print groups.

    ``pairs`` is the number of row pairs a line stands for: n1 * n2 for two prints, and
    n * (n - 1) / 2 for the copies inside one print (``print1 = print2``, distance 0).
    An empty ``within`` searches across labels as well.
    """
    within = list(within)
    near = near_prints(groups, threshold, bits, within, bucket_rows=bucket_rows)
    one = groups.select(*within, F.col("print").alias("print1"), F.col("n").alias("n1"),
                        F.col("first").alias("first1"))
    two = groups.select(*within, F.col("print").alias("print2"), F.col("n").alias("n2"),
                        F.col("first").alias("first2"))
    columns = [*within, "print1", "print2", "first1", "first2", "n1", "n2", "distance", "pairs"]
    different = (near.join(one, [*within, "print1"]).join(two, [*within, "print2"])
                 .withColumn("pairs", F.col("n1") * F.col("n2")).select(*columns))
    copies = groups.where(F.col("n") > 1).select(
        *within, F.col("print").alias("print1"), F.col("print").alias("print2"),
        F.col("first").alias("first1"), F.col("first").alias("first2"),
        F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(0).alias("distance"),
        F.expr("n * (n - 1) div 2").alias("pairs"))
    return different.unionByName(copies)


def cross_split_pairs(groups: DataFrame, threshold: int = THRESHOLD, bits: int = 256,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs between the train and the test side, one row per (train print, test print)."""
    flagged = groups.withColumns({"in_train": F.col("n_train") > 0,
                                  "in_test": F.col("n_test") > 0})
    near = near_prints(
        flagged, threshold, bits, flags=["in_train", "in_test"], bucket_rows=bucket_rows,
        wanted=lambda a, b: (a("in_train") & b("in_test")) | (a("in_test") & b("in_train")))
    ways = F.array(
        F.when(F.col("in_train1") & F.col("in_test2"), F.struct(
            F.col("print1").alias("train"), F.col("print2").alias("test"))),
        F.when(F.col("in_test1") & F.col("in_train2"), F.struct(
            F.col("print2").alias("train"), F.col("print1").alias("test"))))
    directed = (near.select(F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("way"),
                            "distance")
                .select(F.col("way.train").alias("train_print"),
                        F.col("way.test").alias("test_print"), "distance"))
    train = groups.select(F.col("print").alias("train_print"), "first_train", "n_train")
    test = groups.select(F.col("print").alias("test_print"), "first_test", "n_test")
    columns = ["train_print", "test_print", "first_train", "first_test", "n_train", "n_test",
               "distance", "pairs"]
    different = (directed.join(train, "train_print").join(test, "test_print")
                 .withColumn("pairs", F.col("n_train") * F.col("n_test")).select(*columns))
    same = (groups.where((F.col("n_train") > 0) & (F.col("n_test") > 0))
            .select(F.col("print").alias("train_print"), F.col("print").alias("test_print"),
                    "first_train", "first_test", "n_train", "n_test",
                    F.lit(0).alias("distance"),
                    (F.col("n_train") * F.col("n_test")).alias("pairs")))
    return different.unionByName(same)


def exact_groups(prints: DataFrame, key: str) -> DataFrame:
    """Groups of equal fingerprints: size and the first two members."""
    hashed = prints.where(F.col("print").isNotNull())
    sizes = hashed.groupBy("print").agg(F.count("*").alias("group_size"))
    heads = (smallest(hashed.select("print", key), ["print"], [key], 2)
             .groupBy("print").agg(F.min(key).alias("path1"), F.max(key).alias("path2")))
    return sizes.where(F.col("group_size") > 1).join(heads, "print")


def hash_totals(prints: DataFrame) -> DataFrame:
    """Images seen, images hashed, groups of equal hashes, rows in those groups."""
    by_print = prints.groupBy("print").agg(F.count("*").alias("n"))
    hashed = F.col("print").isNotNull()
    return by_print.agg(
        F.sum("n").alias("images"),
        F.coalesce(F.sum(F.when(hashed, F.col("n"))), F.lit(0)).alias("hashed"),
        F.count_if(hashed & (F.col("n") > 1)).alias("exact_groups"),
        F.coalesce(F.sum(F.when(hashed & (F.col("n") > 1), F.col("n"))), F.lit(0))
        .alias("rows_in_groups"))


def pair_links(pairs: DataFrame, rows: DataFrame, key: str,
               within: Sequence[str] = ("label",)) -> DataFrame:
    """Path pairs that connect what the pair table connects, linear in the number of rows.

    Two print groups are linked through their first members, and every copy to the first member
    of its own group; connected components are those of the full pair list.
    ``rows`` carries ``first``, the first member of the row's print group.
    """
    between = pairs.where(F.col("distance") > 0).select(
        F.col("first1").alias("path1"), F.col("first2").alias("path2"), "distance")
    inside = rows.where(F.col("first") < F.col(key)).select(
        F.col("first").alias("path1"), F.col(key).alias("path2"), F.lit(0).alias("distance"))
    return between.unionByName(inside)


def distance_report(cross: DataFrame, prints: DataFrame, key: str, examples: int = 10,
                    side: str = "original_split") -> DataFrame:
    """Cross-split pairs by distance: count, risk tier, first examples, how many are not shown.

    Examples come in the order (test, train).  The first ``examples`` row pairs of a distance
    lie in its first ``examples`` print pairs, and use no more than the first ``examples``
    members of a print, so only those are joined back to rows.
    """
    totals = cross.groupBy("distance").agg(F.sum("pairs").alias("pairs"))
    heads = written(smallest(cross, ["distance"], ["first_test", "first_train"], examples,
                             "head").select("distance", "train_print", "test_print"), "heads")

    def members(which: str) -> DataFrame:
        prints_of_side = heads.select(F.col(f"{which}_print").alias("print")).distinct()
        rows = (prints.where(F.col(side) == which).select("print", key)
                .join(prints_of_side, "print", "left_semi"))
        return smallest(rows, ["print"], [key], examples, "place").select(
            F.col("print").alias(f"{which}_print"), F.col(key).alias(f"{which}_path"))

    shown = heads.join(members("train"), "train_print").join(members("test"), "test_print")
    shown = smallest(shown, ["distance"], ["test_path", "train_path"], examples, "example")
    return (shown.select("distance", "example", "train_path", "test_path")
            .join(totals, "distance")
            .select("distance", risk_tier(F.col("distance")).alias("tier"), "pairs",
                    F.greatest(F.col("pairs") - examples, F.lit(0)).alias("not_shown"),
                    "example", "train_path", "test_path"))
