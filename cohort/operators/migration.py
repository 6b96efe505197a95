"""Where rows went: original side against new pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohort.operators.skew import HOT_ROWS, join_groups
from cohort.operators.splits import POOLS

SIDES = ("Training", "Testing")


def moved(original: Column, new: Column) -> Column:
    """Crossed the boundary: Training but not train, or Testing and train."""
    return (((original == "Training") & (new != "train"))
            | ((original == "Testing") & (new == "train")))


def migration_table(original: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """One row per file found on both sides: key, filename, label, original, new.

    Files meet by their source path, of which each is unique, so names may repeat.
    """
    return original.select(key, "filename", "label", "original").join(
        new.select(key, F.col("split").alias("new")), key)


def migration_by_name(original: DataFrame, new: DataFrame) -> DataFrame:
    """The same for sides that share nothing but file names: filename, label, original, new.

    A name must be unique on each side.  Names that are not cannot be matched; they come from
    :func:`ambiguous_names` with the number of their files, which totals have to add.
    """
    return _unique_names(original, ["label", "original"]).join(
        _unique_names(new, ["split"]).withColumnRenamed("split", "new"), "filename").select(
        "filename", "label", "original", "new")


def _unique_names(files: DataFrame, columns: list[str]) -> DataFrame:
    """Files whose name occurs once; a name with many files never becomes a join key."""
    return (files.groupBy("filename")
            .agg(F.count("*").alias("_files"), *[F.min(c).alias(c) for c in columns])
            .where(F.col("_files") == 1).drop("_files"))


def ambiguous_names(files: DataFrame) -> DataFrame:
    return (files.groupBy("filename").agg(F.count("*").alias("files"))
            .where(F.col("files") > 1))


def migration_matrix(migrations: DataFrame) -> DataFrame:
    """Original by new with row totals and row shares (percent)."""
    counts = migrations.groupBy("original").pivot("new", list(POOLS)).count().na.fill(0)
    total = F.col("train") + F.col("val") + F.col("test")
    share = {f"{p}_pct": F.try_divide(F.col(p) * 100.0, F.col("total")) for p in POOLS}
    return counts.withColumn("total", total).withColumns(share)


def leak_directions(migrations: DataFrame) -> DataFrame:
    """Per original side: rows, rows that stayed on their side, rows that crossed."""
    crossed = moved(F.col("original"), F.col("new"))
    return (migrations.groupBy("original")
            .agg(F.count("*").alias("total"), F.count_if(~crossed).alias("kept"),
                 F.count_if(crossed).alias("crossed"))
            .withColumn("crossed_pct", F.col("crossed") * 100.0 / F.col("total")))


def class_migration(migrations: DataFrame) -> DataFrame:
    """Per class: rows out of train, rows into train, all that moved and their share."""
    training, train = F.col("original") == "Training", F.col("new") == "train"
    return (migrations.groupBy("label")
            .agg(F.count("*").alias("total"), F.count_if(training & ~train).alias("train_out"),
                 F.count_if(~training & train).alias("test_in"))
            .withColumn("moved", F.col("train_out") + F.col("test_in"))
            .withColumn("moved_pct", F.col("moved") * 100.0 / F.col("total")))


def overall_migration(migrations: DataFrame) -> DataFrame:
    """Share that moved beside the share a fresh draw of the same sizes would move.

    By chance, a row that was in Training lands outside train with the share of val and test,
    and a Testing row lands in train with the share of train.
    """
    crossed = moved(F.col("original"), F.col("new"))
    training, train = F.col("original") == "Training", F.col("new") == "train"
    totals = migrations.agg(
        F.count("*").alias("total"), F.count_if(crossed).alias("moved"),
        F.count_if(training).alias("_training"), F.count_if(train).alias("_train"))
    n, a, b = F.col("total"), F.col("_training").cast("double"), F.col("_train").cast("double")
    chance = (a * (n - b) + (n - a) * b) * 100.0 / n / n
    return totals.select(
        "total", "moved", (F.col("moved") * 100.0 / n).alias("moved_pct"),
        chance.alias("chance_pct"),
        F.when(F.col("moved") == 0, "boundary preserved").otherwise("boundary crossed")
        .alias("verdict"))


def cluster_moves(rows: DataFrame, clusters: DataFrame, new: DataFrame, key: str,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Members of given clusters with their original and new place; ``?`` if not found."""
    members = join_groups(rows, clusters.select("cluster_id", "size"), ["cluster_id"], "size",
                          hot_rows)
    return (members.join(new.select(key, F.col("split").alias("_new")), key, "left")
            .withColumn("new", F.coalesce("_new", F.lit("?"))).drop("_new"))
