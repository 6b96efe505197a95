"""Channel moments of pixels (or of any numeric columns) and the drift check between splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohort.operators.fingerprint import image_array

DRIFT_LIMIT = 0.02
CHANNELS = ("R", "G", "B")


def pixel_sums(images: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per image and channel: number of pixels, sum and sum of squares on the 0-1 scale."""
    keep = list(keep)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, (h, w, c, data) in enumerate(zip(batch["height"], batch["width"],
                                                    batch["nChannels"], batch["data"])):
                pixels = image_array(h, w, c, data).reshape(-1, 3) / 255.0
                for channel, name in enumerate(CHANNELS):
                    x = pixels[:, channel]
                    rows.append((*batch.loc[i, keep], name, x.size, x.sum(), (x * x).sum()))
            yield pd.DataFrame(rows, columns=[*keep, "channel", "n", "s", "ss"])

    good = images.where(F.col("image.height") > 0).select(
        *keep, "image.height", "image.width", "image.nChannels", "image.data")
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, "
                   for f in images.select(*keep).schema.fields)
    return good.mapInPandas(sums, f"{kept}channel string, n bigint, s double, ss double")


def column_sums(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The same shape as :func:`pixel_sums` with numeric columns as channels.

    Summed column by column in one pass; only the sums are turned into rows.
    """
    wide = df.groupBy(*keep).agg(*[
        F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("s"),
                 F.sum(F.col(c).cast("double") * F.col(c).cast("double")).alias("ss")).alias(c)
        for c in columns])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"{c}.n").alias("n"),
                 F.col(f"{c}.s").alias("s"), F.col(f"{c}.ss").alias("ss"))
        for c in columns])).alias("cell")
    return wide.select(*keep, cells).select(*keep, "cell.*")


def channel_moments(sums: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Pixel-weighted mean and population standard deviation per channel."""
    n = F.sum("n")
    mean = F.sum("s") / n
    return sums.groupBy(*groups, "channel").agg(
        n.alias("n"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))).alias("std"))


def drift(moments: DataFrame, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Spread of mean and std between splits per channel; OK below the limit."""
    spreads = moments.groupBy("channel").agg(
        (F.max("mean") - F.min("mean")).alias("mean"), (F.max("std") - F.min("std")).alias("std"))
    long = spreads.select("channel", F.explode(F.array(
        F.struct(F.lit("mean").alias("stat"), F.col("mean").alias("spread")),
        F.struct(F.lit("std").alias("stat"), F.col("std").alias("spread")))).alias("s"))
    return long.select("channel", "s.stat", "s.spread",
                       F.when(F.col("s.spread") < limit, "OK").otherwise("DRIFT").alias("status"))
