"""Pairs of vectors with a cosine of at least a threshold: exact, pruned by a tree of balls.

Angles obey the triangle inequality.  Vectors lie in the ball of their nearest pivot, and within it
in the sub-ball of the nearest of its own pivots.  Members of two balls can only be within theta if
the angle of the pivots is at most the two radii and theta, so a sub-ball first meets the balls, and
then the sub-balls of the balls that it has met.  There are about the square root of (vectors /
sub-ball size) balls, and as many sub-balls in each.  A sub-ball of very many vectors is cut into
blocks.  Equal vectors are folded into one first.

Blocks stand in the order of the balls, and the order is cut into strips of equal length.  A pair
of strips is a tile: one task gets the blocks of both that meet there and compares those that may
hold a pair.  So a vector moves once for every strip that it meets and not for every block; the
strips follow the cores, and only tables of more than ``TILE_ROWS`` for each strip get more.

Nothing is left out, so where vectors form no clusters no bound prunes, and half of all pairs are
compared: that is the worst case for time, and a vector is then moved once for every strip.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohort.functions.keyed import seeded_key, seeded_uniform
from cohort.functions.vectors import unit
from cohort.operators.skew import join_groups
from cohort.session import written

BLOCK_ROWS = 2_000
#: Candidates for each pivot, sub-balls of a ball at most (times the balls), and rows of one group
#: that are placed or compared with pivots at once.
CANDIDATES, MOST_SUBS, CHUNK = 4, 4, 1_000
#: Tiles for each core, vectors of a strip at most, and result rows that a task holds before it
#: hands them on (and those of one more pair of blocks).
TILES, TILE_ROWS, OUT_ROWS = 4, 50_000, 50_000
_SLACK = 1e-6


class BallTree(NamedTuple):
    """Vectors with their ball and sub-ball, sub-balls with pivot, radius and size, and the balls."""
    members: DataFrame
    leaves: DataFrame
    pivots: np.ndarray
    radius: np.ndarray


def vector_groups(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per distinct direction-bearing vector: first key, members, unit vector."""
    values = F.col(vector).cast("array<double>")
    return (df.groupBy(values.alias("v"))
            .agg(F.min(key).alias("first"), F.count("*").alias("n"))
            .withColumn("v", unit(F.col("v"))).where(F.col("v").isNotNull()))


def _angles(vectors: pd.Series, points: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.stack(vectors.to_list()) @ points.T, -1, 1))


def _far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the points, each the furthest from those before it."""
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def _in_chunks(rows: DataFrame, others: DataFrame, ball: str):
    """Cogroup rows with the few others of their ball, at most about ``CHUNK`` rows at a time."""
    # one line per ball
    sizes = F.broadcast(rows.groupBy(ball).agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in ("v", ball))), F.col("parts"))
    dealt = rows.join(sizes, ball).withColumn("part", part.cast("int")).drop("parts")
    copied = others.join(sizes, ball).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy(ball, "part").cogroup(copied.groupBy(ball, "part"))


def ball_tree(groups: DataFrame, pivots: int | None = None, leaf_rows: int = BLOCK_ROWS // 2,
              seed: int = 42) -> BallTree | None:
    """The tree over distinct vectors ``groups`` (a written table), None if there are none.

    The driver sees the candidates for the ball pivots, which grow with the square root of the
    table, and one line per ball.
    """
    spark, total = groups.sparkSession, groups.count()
    if not total:
        return None
    kind = groups.schema["first"].dataType.simpleString()
    count = pivots or int(np.ceil(np.sqrt(total / leaf_rows)))
    sample = groups.orderBy(seeded_key(seed, F.col("first")), "first").limit(CANDIDATES * count)
    points = _far_apart(np.array([row["v"] for row in sample.select("v").collect()]), count)

    def to_balls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty:
                angles = _angles(frame["v"], points)
                yield frame[["first", "n", "v"]].assign(ball=angles.argmin(axis=1),
                                                        angle=angles.min(axis=1))

    near = written(groups.select("first", "n", "v").mapInPandas(
        to_balls, f"first {kind}, n bigint, v array<double>, ball int, angle double"), "balls")
    radius, lines = np.zeros(len(points)), []
    for ball, size, angle in near.groupBy("ball").agg(F.count("*"), F.max("angle")).collect():
        radius[ball] = angle
        lines.append((ball, min(-(-size // leaf_rows), MOST_SUBS * count), size))
    wanted = F.broadcast(spark.createDataFrame(lines, "ball int, subs int, size bigint"))
    drawn = near.join(wanted, "ball").where(
        seeded_uniform(seed + 1, F.col("first")) * F.col("size") < F.col("subs") * CANDIDATES)
    tops = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)],
                                 "ball int, v array<double>").join(wanted, "ball")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        chosen = _far_apart(np.stack(frame["v"].to_list()), int(frame["subs"].iloc[0]))
        return pd.DataFrame({"ball": frame["ball"].iloc[0], "sub": np.arange(len(chosen)),
                             "v": list(chosen)})

    subs = written(drawn.select("ball", "subs", "v").unionByName(tops.select("ball", "subs", "v"))
                   .groupBy("ball").applyInPandas(choose, "ball int, sub int, v array<double>"),
                   "sub-pivots")

    def place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or pivots.empty:
            return pd.DataFrame(columns=["first", "n", "v", "ball", "sub", "angle"])
        angles = _angles(rows["v"], np.stack(pivots["v"].to_list()))
        return rows[["first", "n", "v", "ball"]].assign(
            sub=pivots["sub"].to_numpy()[angles.argmin(axis=1)], angle=angles.min(axis=1))

    members = written(_in_chunks(near.drop("angle"), subs, "ball").applyInPandas(
        place, f"first {kind}, n bigint, v array<double>, ball int, sub int, angle double"),
        "sub-balls")
    leaves = written(members.groupBy("ball", "sub").agg(
        F.count("*").alias("size"), F.max("angle").alias("radius")).join(subs, ["ball", "sub"]),
        "leaves")
    return BallTree(members, leaves, points, radius)


def leaf_pairs(tree: BallTree, threshold: float) -> DataFrame:
    """(ball1, sub1, size1, ball2, sub2, size2): sub-balls that may hold a pair, each pair once."""
    theta = float(np.arccos(np.clip(threshold, -1, 1)))
    points, radius = tree.pivots, tree.radius

    def met_balls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            own = frame["ball1"].to_numpy()
            near = _angles(frame["v"], points) <= (
                frame["radius1"].to_numpy()[:, None] + radius[None, :] + theta + _SLACK)
            near &= np.arange(len(points))[None, :] >= own[:, None]
            row, ball = np.nonzero(near)
            yield frame.iloc[row].assign(ball=ball)

    def met_leaves(visitors: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        names = ["ball1", "sub1", "size1", "ball2", "sub2", "size2"]
        if visitors.empty or leaves.empty:
            return pd.DataFrame(columns=names)
        near = _angles(visitors["v"], np.stack(leaves["v"].to_list())) <= (
            visitors["radius1"].to_numpy()[:, None] + leaves["radius"].to_numpy()[None, :]
            + theta + _SLACK)
        near &= ((visitors["ball1"].to_numpy() < visitors["ball"].to_numpy())[:, None]
                 | (visitors["sub1"].to_numpy()[:, None] <= leaves["sub"].to_numpy()[None, :]))
        i, j = np.nonzero(near)
        one, two = visitors.iloc[i], leaves.iloc[j]
        columns = [one["ball1"], one["sub1"], one["size1"], two["ball"], two["sub"], two["size"]]
        return pd.DataFrame({n: c.to_numpy() for n, c in zip(names, columns)})

    visitors = written(tree.leaves.select(
        F.col("ball").alias("ball1"), F.col("sub").alias("sub1"), F.col("size").alias("size1"),
        F.col("radius").alias("radius1"), "v").mapInPandas(
            met_balls, "ball1 int, sub1 int, size1 bigint, radius1 double, v array<double>, "
                       "ball int"), "visits")
    return _in_chunks(visitors, tree.leaves, "ball").applyInPandas(
        met_leaves, "ball1 int, sub1 int, size1 bigint, ball2 int, sub2 int, size2 bigint")


def _block_places(leaves: DataFrame, block_rows: int) -> DataFrame:
    """Sub-balls with their number of blocks and ``start``, the rows of the sub-balls before them."""
    before = Window.orderBy("ball").rowsBetween(Window.unboundedPreceding, -1)
    # one line per ball
    balls = F.broadcast(leaves.groupBy("ball").agg(F.sum("size").alias("rows")).select(
        "ball", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ball_start")))
    inside = Window.partitionBy("ball").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.join(balls, "ball").select(
        "ball", "sub", "size", F.ceil(F.col("size") / block_rows).cast("int").alias("blocks"),
        (F.col("ball_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))


def _block_place(block: str):
    """Names a block by its place in the order, which no other block has."""
    return F.col("start") + F.expr(f"{block} * size div blocks")


def _compared(threshold: float):
    """Pairs of one tile: its vectors with their blocks, and lines of two blocks to compare."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(batches)
        kind = tile.schema.field("first").type
        lines, rows = tile.filter(pc.is_null(tile["v"])), tile.filter(pc.is_valid(tile["v"]))
        rows = rows.sort_by("block1")
        if not len(lines) or not len(rows):
            return
        values = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = values.reshape(len(rows), -1)
        names = rows["first"].to_numpy()
        counts, blocks = rows["n"].to_numpy(), rows["block1"].to_numpy()
        pairs = [lines[c].to_numpy() for c in ("block1", "block2")]
        edges = [np.searchsorted(blocks, block, side) for block in pairs for side in ("left", "right")]
        kept, waiting = [], 0
        for one, two, a, b, c, d in zip(*pairs, *edges):
            cosine = vectors[a:b] @ vectors[c:d].T
            i, j = np.nonzero(cosine >= threshold)
            found = cosine[i, j]
            i, j = i + a, j + c
            swap = names[j] < names[i]
            if one == two:  # a block meets itself both ways
                keep = names[i] < names[j]
                i, j, found, swap = i[keep], j[keep], found[keep], swap[keep]
            kept.append((np.where(swap, j, i), np.where(swap, i, j), found))
            waiting += len(i)
            if waiting >= OUT_ROWS:
                yield made(kept, names, counts, kind)
                kept, waiting = [], 0
        if waiting:
            yield made(kept, names, counts, kind)

    def made(kept, names, counts, kind: pa.DataType) -> pa.RecordBatch:
        i, j, found = (np.concatenate(column) for column in zip(*kept))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[i], kind), pa.array(names[j], kind), pa.array(found),
             pa.array(counts[i] * counts[j])], names=["first1", "first2", "cosine", "pairs"])

    return compare


def cosine_pairs(groups: DataFrame, threshold: float = 0.95, pivots: int | None = None,
                 block_rows: int = BLOCK_ROWS, seed: int = 42,
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """(first1, first2, cosine, pairs) for distinct vectors with a cosine >= threshold.

    ``pairs`` is the number of row pairs behind a line, as for fingerprint pairs; the copies
    inside one vector are a line of their own with ``first1 = first2``.
    """
    groups = written(groups, "vectors")
    spark, kind = groups.sparkSession, groups.schema["first"].dataType.simpleString()
    tree = ball_tree(groups, pivots, max(block_rows // 2, 1), seed)
    if tree is None:
        return spark.createDataFrame(
            [], f"first1 {kind}, first2 {kind}, cosine double, pairs bigint")
    places = written(_block_places(tree.leaves, block_rows), "places")
    total = places.agg(F.sum("size")).first()[0]
    strips = int(np.ceil(max(np.sqrt(2 * TILES * spark.sparkContext.defaultParallelism),
                             total / tile_rows)))
    length = max(-(-total // strips), block_rows)
    strips = -(-total // length)

    def blocks(k: int) -> DataFrame:
        each = places.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return each.select(F.col("ball").alias(f"ball{k}"), F.col("sub").alias(f"sub{k}"),
                           _block_place("block").alias(f"block{k}"))

    # sub-balls meet in the order of their places
    grid = written(
        leaf_pairs(tree, threshold).select("ball1", "sub1", "ball2", "sub2")
        .join(blocks(1), ["ball1", "sub1"]).join(blocks(2), ["ball2", "sub2"])
        .where(F.col("block1") <= F.col("block2"))
        .select("block1", "block2", *(F.expr(f"int(block{k} div {length})").alias(f"strip{k}")
                                      for k in (1, 2))), "grid")
    tiles = written(
        grid.select("block1", "strip1", "strip2").union(grid.select("block2", "strip1", "strip2"))
        .groupBy("block1").agg(F.collect_set(F.struct("strip1", "strip2")).alias("tiles")), "tiles")
    placed = join_groups(tree.members.drop("angle"), places, ["ball", "sub"], "size").withColumn(
        "block", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")).select(
        _block_place("block").alias("block1"), "first", "n", "v")
    sent = (placed.join(tiles, "block1").withColumn("tile", F.explode("tiles"))
            .select("tile.strip1", "tile.strip2", "block1", "first", "n", "v"))
    tile = ["strip1", "strip2"]
    different = (sent.unionByName(grid, allowMissingColumns=True)
                 .repartition(strips * strips, *tile).groupBy(*tile)
                 .applyInArrow(_compared(threshold),
                               f"first1 {kind}, first2 {kind}, cosine double, pairs bigint"))
    copies = groups.where(F.col("n") > 1).select(
        F.col("first").alias("first1"), F.col("first").alias("first2"),
        F.lit(1.0).alias("cosine"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return different.unionByName(copies)
