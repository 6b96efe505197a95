"""Training-set preparation: weights, seeded resampling, batches, mixing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohort.functions.keyed import seeded_key, seeded_uniform
from cohort.operators.catalog import dictionary
from cohort.operators.skew import global_rank


def class_weights(df: DataFrame, classes: Sequence, label: str = "label") -> DataFrame:
    """``N / (C * n_c)`` for every class of the dictionary; a class without rows counts as one."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = (dictionary(df.sparkSession, classes, label).join(counts, label, "left")
             .withColumn("n", F.coalesce("n", F.lit(0))))
    total = F.sum("n").over(Window.partitionBy())
    return every.withColumn("weight", total / (len(classes) * F.greatest("n", F.lit(1))))


def sample_weights(df: DataFrame, classes: Sequence, label: str = "label") -> DataFrame:
    """Each row with the weight of its class; the weights are one row per class."""
    weights = class_weights(df, classes, label).select(label, "weight")
    return df.join(F.broadcast(weights), label)


def weighted_resample(df: DataFrame, key: str, classes: Sequence, draws: int | None = None,
                      seed: int = 42, label: str = "label") -> DataFrame:
    """Draw rows with replacement, each class as likely as any other that has rows.

    Every draw hashes its number twice: once to pick the class, once to pick the row within the
    class by rank.  Draws are independent, repeatable, and joined on (class, rank), where ranks
    are unique, so no class gathers in one task.  Default size: as many draws as rows.
    """
    known = df.where(F.col(label).isin(*classes))
    sizes = {r[0]: r[1] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    present = [c for c in classes if c in sizes]
    total = draws if draws is not None else sum(sizes.values())
    names = F.array(*[F.lit(c) for c in present])
    counts = F.array(*[F.lit(sizes[c]) for c in present])
    slot = F.least(F.floor(seeded_uniform(seed, F.lit("class"), F.col("draw")) * len(present)),
                   F.lit(len(present) - 1)).cast("int")
    drawn = (df.sparkSession.range(total).withColumnRenamed("id", "draw")
             .withColumn("_slot", slot)
             .select("draw", names[F.col("_slot")].alias(label),
                     (F.floor(seeded_uniform(seed, F.lit("row"), F.col("draw"))
                              * counts[F.col("_slot")]) + 1).cast("bigint").alias("_rank")))
    keyed = known.withColumn("_order", seeded_key(seed, F.lit("rank"), F.col(key)))
    ranked = global_rank(keyed, "_order", key, [label], "_rank").drop("_order")
    return drawn.join(ranked, [label, "_rank"]).drop("_rank")


#: Largest mean that one Poisson draw takes; larger ones are sums of several draws.
MEAN = 8.0


def poisson_cuts(mean: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... as long as a draw of 52 bits can lie above it."""
    term = total = math.exp(-mean)
    cuts = [total]
    while total < 1 - 2.0 ** -53 and term > 0 and len(cuts) < 200:
        term *= mean / len(cuts)
        total += term
        cuts.append(total)
    return cuts


def _below(cuts: Column):
    """How many of the cuts a draw has reached."""
    return lambda u: F.size(F.filter(cuts, lambda c: c <= u))


def poisson_resample(df: DataFrame, key: str, classes: Sequence, draws: int | None = None,
                     seed: int = 42, label: str = "label") -> DataFrame:
    """Rows with replacement by independent Poisson counts; adds ``copy`` from 1.

    Every row of a class comes draws / (classes with rows * rows of its class) times on average, so
    classes come out equally large and ``draws`` (default: all rows) is the expected size.  One pass
    after the counts of the classes: no rank, no join, no shuffle.  Rows of equal key get equal
    counts; null keys draw as one.
    """
    known = df.where(F.col(label).isin(*classes))
    sizes = {r[0]: r[1] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = draws if draws is not None else sum(sizes.values())
    count = F.lit(0)
    for name, n in sizes.items():
        mean = total / (len(sizes) * n)
        parts = max(1, math.ceil(mean / MEAN))
        cuts = F.array(*[F.lit(c) for c in poisson_cuts(mean / parts)])

        drawn = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: seeded_uniform(
            seed, F.lit("poisson"), F.col(key), i))
        each = F.transform(drawn, _below(cuts))
        count = F.when(F.col(label) == name, F.aggregate(
            each, F.lit(0), lambda a, b: a + b)).otherwise(count)
    return (known.withColumn("_count", count).where(F.col("_count") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count"))


def shuffled(df: DataFrame, key: str, seed: int = 42, epoch: int = 0,
             name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in the seeded order of an epoch."""
    keyed = df.withColumn("_order", seeded_key(seed, F.lit(epoch), F.col(key)))
    return global_rank(keyed, "_order", key, name=name).drop("_order")


def batches(df: DataFrame, key: str, batch_size: int, seed: int = 42, epoch: int = 0,
            drop_last: bool = False) -> DataFrame:
    """Add ``batch_id`` and the place in the batch; an incomplete last batch may be left out."""
    placed = shuffled(df, key, seed, epoch)
    zero = F.col("position") - 1
    out = placed.withColumns({"batch_id": F.floor(zero / batch_size).cast("bigint"),
                              "slot": (zero % batch_size).cast("int")})
    if drop_last:
        full = df.count() // batch_size
        out = out.where(F.col("batch_id") < full)
    return out.drop("position")


def mix_lambda(batch_id: Column, alpha: float, seed: int = 42) -> Column:
    """One Beta(alpha, alpha) draw per batch; 1 without mixing, uniform for alpha 1."""
    if alpha <= 0:
        return F.lit(1.0)
    if alpha == 1.0:
        return seeded_uniform(seed, F.lit("lambda"), batch_id)

    @F.pandas_udf(T.DoubleType())
    def beta(ids: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(i)]).beta(alpha, alpha) for i in ids],
                         dtype=float)

    return beta(batch_id)


def mixup(batched: DataFrame, key: str, vector: str, label: str = "label", alpha: float = 0.2,
          seed: int = 42) -> DataFrame:
    """``lam * x + (1 - lam) * x[perm]`` inside each batch, with both labels and lambda kept.

    The partner comes from a second seeded order of the batch: rows in slot order meet rows in
    shuffled order.  Batches are small, so the window of a batch is too.
    """
    order = seeded_key(seed, F.lit("partner"), F.col(key))
    in_order = Window.partitionBy("batch_id").orderBy("slot")
    at_random = Window.partitionBy("batch_id").orderBy(order, key)
    left = batched.withColumns({"_place": F.row_number().over(in_order),
                                "lam": mix_lambda(F.col("batch_id"), alpha, seed)})
    right = batched.select(
        "batch_id", F.row_number().over(at_random).alias("_place"),
        F.col(key).alias("partner"), F.col(vector).alias("_other"), F.col(label).alias("label_b"))
    mixed = F.zip_with(F.col(vector), F.col("_other"),
                       lambda x, y: F.col("lam") * x + (1 - F.col("lam")) * y)
    return (left.join(right, ["batch_id", "_place"])
            .select("batch_id", "slot", key, "partner", "lam", F.col(label).alias("label_a"),
                    "label_b", mixed.alias("mixed")))
