"""Catalog profile: class balance, split by class, top-k counts, samples, examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohort.functions.keyed import seeded_key
from cohort.operators.skew import smallest

# Class dictionary of the image set, in alphabetical order.
CLASS_TO_IDX = {"glioma": 0, "meningioma": 1, "notumor": 2, "pituitary": 3}


def dictionary(spark: SparkSession, classes: Sequence, name: str = "label") -> DataFrame:
    """One row per class of a fixed dictionary."""
    values = F.array(*[F.lit(c) for c in classes])
    return spark.range(1).select(F.explode(values).alias(name))


def encode_labels(df: DataFrame, classes: dict[str, int], label: str = "label") -> DataFrame:
    """Add ``label_idx``; rows of unknown classes are left out (see ``unknown_classes``)."""
    index = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return (df.withColumn("label_idx", F.try_element_at(index, F.col(label)).cast("bigint"))
            .where(F.col("label_idx").isNotNull()))


def unknown_classes(df: DataFrame, classes: dict[str, int], label: str = "label") -> DataFrame:
    """Classes outside the dictionary and how many rows each would lose."""
    known = dictionary(df.sparkSession, list(classes), label)
    return (df.groupBy(label).agg(F.count("*").alias("rows"))
            .join(F.broadcast(known), label, "left_anti"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share (percent) per class."""
    everything = Window.partitionBy()
    return (df.groupBy(label).agg(F.count("*").alias("n"))
            .withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(everything)))


def split_by_class(df: DataFrame, splits: Sequence[str], classes: Sequence[str],
                   split: str = "split", label: str = "label") -> DataFrame:
    """Rows per split and class with totals, zero-filled; NULL stands for "all".

    ``pct`` is the share within the split.
    """
    spark = df.sparkSession
    every_split = dictionary(spark, [*splits, None], "split")
    every = every_split.withColumn(
        "label", F.explode(F.array(*[F.lit(c) for c in classes], F.lit(None))))
    cells = df.groupBy(F.col(split).alias("split"), F.col(label).alias("label")).agg(
        F.count("*").alias("n"))
    counts = cells.cube("split", "label").agg(F.sum("n").alias("n"))
    same = (every["split"].eqNullSafe(counts["split"])
            & every["label"].eqNullSafe(counts["label"]))
    of_split = Window.partitionBy("split")
    return (every.join(counts, same, "left")
            .select(every["split"], every["label"], F.coalesce("n", F.lit(0)).alias("n"))
            .withColumn("pct", F.try_divide(
                F.col("n") * 100.0,
                F.max(F.when(F.col("label").isNull(), F.col("n"))).over(of_split))))


def top_counts(df: DataFrame, columns: Sequence[str | Column], k: int) -> DataFrame:
    """The ``k`` most frequent combinations; ties in the order of the columns."""
    counted = df.groupBy(*columns).agg(F.count("*").alias("n"))
    names = [c for c in counted.columns if c != "n"]
    return counted.orderBy(F.desc("n"), *names).limit(k)


def distinct_combinations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct().agg(F.count("*").alias("distinct_n"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same rows on every run; a top-k, not a sort."""
    keyed = df.withColumn("_key", seeded_key(seed, F.col(key)))
    return keyed.orderBy("_key", key).limit(n).drop("_key")


def first_examples(df: DataFrame, k: int, groups: Sequence[str], order: str) -> DataFrame:
    """First ``k`` rows of each group (class, or class and split) by name."""
    return smallest(df, groups, [order], k, "example")


def absent_classes(df: DataFrame, splits: Sequence[str], classes: Sequence[str],
                   split: str = "split", label: str = "label") -> DataFrame:
    """Classes that a split does not have at all."""
    every = dictionary(df.sparkSession, splits, split).withColumn(
        label, F.explode(F.array(*[F.lit(c) for c in classes])))
    present = df.select(split, label).distinct()
    return every.join(present, [split, label], "left_anti")
