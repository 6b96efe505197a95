"""Image folders: catalog scan, decode with quarantine, split folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohort.functions.keyed import seeded_key
from cohort.functions.names import (IMAGE_EXTENSIONS, SCAN_EXTENSIONS, base_name, path_label,
                                    path_split, suffix)
from cohort.operators.skew import global_rank
from cohort.session import written

# Colour modes by OpenCV type code of the image source.
MODES = {0: "L", 16: "RGB", 24: "RGBA"}


def with_place(files: DataFrame) -> DataFrame:
    """Add label and original side, both read from the path."""
    return files.withColumns({"label": path_label(F.col("path")),
                              "original_split": path_split(F.col("path"))})


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(suffix(path)).isin(*extensions)


def file_name(origin: Column) -> Column:
    """The path that the image source writes with percent signs, as other sources write it."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(origin, r"\+", "%2B")), origin)


def scan_images(spark: SparkSession, folder: str,
                extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Catalog of a folder tree: path, length, label, original_split.  Content is not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path", "length"))
    return with_place(files.where(has_extension(F.col("path"), extensions)))


def decode_images(spark: SparkSession, folder: str | list[str],
                  extensions: Sequence[str] = SCAN_EXTENSIONS) -> DataFrame:
    """Decoded images with path, size and colour mode; ``error`` is set where decoding failed.

    Every file is decoded in full, so truncated pixel data is found too.
    """
    images = (spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
              .withColumn("path", file_name(F.col("image.origin"))))
    images = with_place(images.where(has_extension(F.col("path"), extensions)))
    mode = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    bad = F.col("image.height") <= 0
    return images.withColumns({
        "width": F.when(~bad, F.col("image.width")),
        "height": F.when(~bad, F.col("image.height")),
        "mode": F.when(~bad, F.try_element_at(mode, F.col("image.mode"))),
        "error": F.when(bad, "image could not be decoded")})


def readable(images: DataFrame) -> DataFrame:
    return images.where(F.col("error").isNull())


def quarantined(images: DataFrame) -> DataFrame:
    return images.where(F.col("error").isNotNull()).select("path", "label", "error")


def split_manifest(assigned: DataFrame) -> DataFrame:
    """Add ``destination`` (split/label/name); a name that is taken gets ``_1``, ``_2``, ...

    Files with the same destination are ranked in hash order, range by range, so a name that
    very many files share is not sorted in one task.  Renaming repeats until all are distinct,
    because ``x_1.jpg`` may itself be taken; files that keep their own name come first.
    """
    renamed = F.col("_name") != base_name(F.col("path"))
    named = assigned.withColumn("_name", base_name(F.col("path")))
    while True:
        keyed = named.withColumn("_order", F.concat(
            F.when(renamed, "1").otherwise("0"), seeded_key(0, F.col("path"))))
        ranked = global_rank(keyed, "_order", "path", ["split", "label", "_name"], "_rank")
        ranked = written(ranked.drop("_order"), "manifest")
        extension = suffix(F.col("_name"))
        bare = F.substring(F.col("_name"), F.lit(1), F.length("_name") - F.length(extension))
        again = F.concat(bare, F.lit("_"), (F.col("_rank") - 1).cast("string"), extension)
        clash = F.col("_rank") > 1
        if ranked.where(clash).isEmpty():
            break
        named = ranked.withColumn("_name", F.when(clash, again).otherwise(F.col("_name"))).drop(
            "_rank")
    return (ranked.withColumn("destination", F.concat_ws("/", "split", "label", "_name"))
            .drop("_name", "_rank"))


def write_split(manifest: DataFrame, folder: str, force: bool = False) -> None:
    """Write rows (with their content, if they carry any) as split=/label= partitions."""
    manifest.write.mode("overwrite" if force else "errorifexists").partitionBy(
        "split", "label").parquet(folder)


def read_split(spark: SparkSession, folder: str, splits: Sequence[str] | None = None,
               labels: Sequence[str] | None = None) -> DataFrame:
    """Rows that ``write_split`` has written; only the folders asked for are read."""
    rows = spark.read.parquet(folder)
    if splits is not None:
        rows = rows.where(F.col("split").isin(*splits))
    return rows if labels is None else rows.where(F.col("label").isin(*labels))


def read_split_of(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Rows of the (split, label) folders that the table ``wanted`` names, pruned as it is read.

    The names are broadcast: pools times classes at most.
    """
    # Spark prunes by a join only if the other side is filtered
    pairs = wanted.where("split <> '' AND label <> ''").select("split", "label").distinct()
    return spark.read.parquet(folder).join(F.broadcast(pairs), ["split", "label"], "left_semi")
