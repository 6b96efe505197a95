"""Start a stream over what is there now, write files, read the result back."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from cohort.session import STATE_STORE, scratch_path


def with_end(stream: DataFrame, end: datetime.datetime, ts: str = "ts") -> DataFrame:
    """The stream and one row far after its ``end``, null but for the time.

    The row lifts the watermark over all others, so windows, sessions and waiting rows that would
    stay open when the input ends are closed; its own stay open and are never shown.  For input
    that one batch reads; where it takes several, put such a row into the last file instead.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "end")
    row = [F.lit(end + datetime.timedelta(days=30)).cast(f.dataType) if f.name == ts
           else F.lit(None).cast(f.dataType) for f in stream.schema]
    marker = spark.range(1).select(*(c.alias(f.name) for c, f in zip(row, stream.schema)))
    marker.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet folder and return it as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    spark.conf.set(*STATE_STORE)
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", path).option("checkpointLocation", f"{path}-progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
