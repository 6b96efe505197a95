"""Pair tables, metric files and training histories."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

PAIR_SCHEMA = "path1 string, path2 string, distance int"
HISTORY_COLUMNS = ("train_loss", "train_acc", "val_loss", "val_acc", "val_f1_macro", "lr",
                   "epoch_time")
RAW_ARRAYS = ("predictions", "labels", "probabilities", "roc_curves")


def write_pairs(pairs: DataFrame, path: str, format: str = "parquet") -> None:
    pairs.select("path1", "path2", "distance").write.mode("overwrite").format(format).save(path)


def read_pairs(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The pair table, or an empty one if none was ever written."""
    try:
        return spark.read.schema(PAIR_SCHEMA).format(format).load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], PAIR_SCHEMA)


def write_metrics(document: DataFrame, path: str, drop: tuple[str, ...] = RAW_ARRAYS) -> None:
    """Metric documents as JSON lines, without the bulky raw arrays."""
    document.drop(*drop).write.mode("overwrite").json(path)


def write_history(history: DataFrame, path: str) -> None:
    """One folder per run with one file of equal-length arrays, epochs in order."""
    entry = F.struct("epoch", *[F.col(c).cast("double").alias(c) for c in HISTORY_COLUMNS])
    runs = history.groupBy("run").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    runs.select("run", *[F.col(f"e.{c}").alias(c) for c in HISTORY_COLUMNS]).write.mode(
        "overwrite").partitionBy("run").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and epoch from files of equal-length arrays; the run is the folder's name."""
    schema = ", ".join(f"{c} array<double>" for c in HISTORY_COLUMNS)
    files = (spark.read.schema(schema).option("multiLine", "true")
             .option("recursiveFileLookup", "true").json(path)
             .withColumn("run", F.regexp_replace(F.element_at(
                 F.split(F.input_file_name(), "/"), -2), "^run=", "")))
    epochs = files.select("run", F.posexplode(F.arrays_zip(*HISTORY_COLUMNS)).alias("at", "e"))
    return epochs.select("run", (F.col("at") + 1).alias("epoch"), "e.*")
