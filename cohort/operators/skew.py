"""Joins and ranks that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.session import written

HOT_ROWS = 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str = "n",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows to one row per key that knows how many rows the key has.

    Groups of at least ``hot_rows`` rows are broadcast: there can be no more of them than
    total rows / ``hot_rows``, whatever the skew.  All other keys are shuffled as usual.
    ``rows`` and ``groups`` are read more than once and should be written tables or cheap.
    """
    keys = list(keys)
    hot = groups.where(F.col(size) >= hot_rows)
    if hot.isEmpty():
        return rows.join(groups, keys)
    rest = groups.where(F.col(size) < hot_rows)
    hot_side = rows.join(F.broadcast(hot), keys)
    cold_side = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return hot_side.unionByName(cold_side)


def global_rank(df: DataFrame, order_key: str, tie: str, within: Sequence[str] = (),
                name: str = "rank", digits: int | None = None) -> DataFrame:
    """1-based rank by ``order_key`` and ``tie`` without sorting in one task.

    Sampled splitters deal the rows into even ranges of (``within``, order), whatever the keys look
    like and however many rows a group has.  The sorted ranges are written once; a row's rank is
    its place in its range plus the totals of the ranges before it that have its group.  There are
    ``spark.sql.shuffle.partitions`` ranges, or 16 ** ``digits``; rows of equal order are ranked in
    any order.
    """
    within = list(within)
    order = [*within, order_key, tie]
    count = 16 ** digits if digits else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "ranges")
    # the id holds the range in its upper bits and the place in it below
    part = F.shiftright("_at", 33)
    before = Window.partitionBy(*(f"_w{i}" for i in range(len(within)))).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(part.alias("_part"), *(
        F.col(c).alias(f"_w{i}") for i, c in enumerate(within))).agg(
            F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn(
            "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first"))
    same = part == F.col("_part")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return ranged.join(offsets, same).withColumn(
        name, (F.col("_at") + F.col("_before")).cast("bigint")).drop(
        "_at", "_part", "_n", "_first", "_before", *(f"_w{i}" for i in range(len(within))))


def smallest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
             name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Every map task keeps ``k`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def running_max(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, value: Column,
                name: str, strict: bool = False) -> DataFrame:
    """Running maximum of ``value`` along ``order`` per key, cut into chunks of the order.

    A long key is spread over its chunks; each chunk starts from the maximum of the chunks
    before it.  With ``strict`` the row itself is left out.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (chunked.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_top"))
               .withColumn("_carry", F.max("_top").over(before)).drop("_top"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0)
    return (chunked.withColumn("_inside", F.max("_value").over(inside))
            .join(carried, [*keys, "_chunk"])
            .withColumn(name, F.greatest("_inside", "_carry"))
            .drop("_chunk", "_value", "_inside", "_carry"))
