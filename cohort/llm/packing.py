"""Best-fit packing into sequences of several permitted lengths.

Documents are cut at the largest length, pieces go in descending order into the open bin that
they fill best, and a new bin is opened in the size that costs least for the piece, given what
the space left over is worth.  That worth is not known beforehand, so each group is packed for
several values of it and the cheapest result is kept.  Last, each bin shrinks to the smallest
length that holds its content.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohort.session import written

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: Pieces that are packed together; more do not fill bins noticeably better.
GROUP = 20_000
#: Shares of a bin's free space that are expected to be filled later.
WORTHS = (1.0, 0.9, 0.75, 0.0)


def step_cost(capacity: int) -> float:
    """Cost of one sequence: a start-up part, a part per token, a part per pair of tokens."""
    return 512 + capacity + capacity * capacity / 65536


def best_fit(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float],
             worth: float) -> tuple[list[int], list[int]]:
    """(bin of each piece, used length of each bin); lengths descend and fit the largest bin."""
    rate = min(cost(c) / c for c in capacities)
    free: list[int] = []  # the different amounts of free space, ascending
    bins: dict[int, list[int]] = {}
    used: list[int] = []
    place = []
    choice: dict[int, int] = {}
    for length in lengths:
        at = bisect_left(free, length)
        if at < len(free):
            room = free[at]
            stack = bins[room]
            number = stack.pop()
            if not stack:
                del bins[room], free[at]
            used[number] += length
        else:
            if length not in choice:
                choice[length] = min(
                    (c for c in capacities if c >= length),
                    key=lambda c: cost(c) - worth * rate * (c - length))
            room, number = choice[length], len(used)
            used.append(length)
        place.append(number)
        left = room - length
        if left:
            if left not in bins:
                insort(free, left)
                bins[left] = []
            bins[left].append(number)
    return place, used


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES,
                 cost: Callable[[int], float] = step_cost, worths: Sequence[float] = WORTHS
                 ) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, used length and capacity of each bin) of the cheapest packing."""
    best = None
    for worth in worths:
        place, used = best_fit(lengths, capacities, cost, worth)
        fitted = [capacities[bisect_left(capacities, u)] for u in used]
        total = sum(map(cost, fitted))
        if best is None or total < best[0]:
            best = total, place, used, fitted
    return best[1:]


def _pack_group(capacities: Sequence[int], cost: Callable[[int], float],
                worths: Sequence[float]):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        place, used, fitted = pack_lengths(pieces.length.tolist(), capacities, cost, worths)
        place = np.array(place)
        before = pieces.length.groupby(place).cumsum() - pieces.length
        first = int(pieces.group.iloc[0]) << 32
        return pieces.assign(bin=first + place, offset=before, capacity=np.array(fitted)[place],
                             used=np.array(used)[place]).drop(columns=["group", "row"])

    return run


def pack(docs: DataFrame, key: str = "doc_id", length: str = "length",
         capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = step_cost,
         worths: Sequence[float] = WORTHS, group: int = GROUP) -> DataFrame:
    """(key, piece, start, length, bin, offset, capacity, used): where each piece lies.

    ``start`` counts from the start of the document, ``offset`` from the start of the bin.
    Every token of every row is in exactly one piece; rows of null, zero or negative length have
    no tokens and so no piece.  Rows that repeat a key are packed one by one.  Other columns are
    ignored.  Pieces are dealt by a hash of their row number into groups of about ``group``.
    """
    capacities = sorted(capacities)
    top = capacities[-1]
    rows = docs.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("whole")
                       ).where(F.col("whole") > 0).withColumn("row",
                                                              F.monotonically_increasing_id())
    cut = rows.withColumn("piece", F.explode_outer(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(whole - 1) div {top}"))))
    pieces = written(cut.select(
        "key", "row", "piece", (F.col("piece") * top).alias("start"),
        F.least(F.lit(top), F.col("whole") - F.col("piece") * top).cast("bigint")
        .alias("length")), "pieces")
    groups = -(-pieces.count() // group) or 1
    kind = pieces.schema["key"].dataType.simpleString()
    packed = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups))).groupBy(
        "group").applyInPandas(
        _pack_group(capacities, cost, worths),
        f"key {kind}, piece bigint, start bigint, length bigint, bin bigint, `offset` bigint, "
        "capacity bigint, used bigint")
    return packed.withColumnRenamed("key", key)
