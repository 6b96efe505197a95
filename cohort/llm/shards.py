"""Contiguous shards of near-equal bytes from a global prefix sum of sizes.

Only DataFrame functions.  Rows are dealt into key ranges, every range keeps its total, the few
totals are summed up in order, and each row learns its global byte and row offset from its own
range.  No step brings rows of different ranges together, and equal keys may span ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohort.session import written


def byte_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                shards: int = 16) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``.

    Rows stand in the order of key, size and checksum (null keys first; rows equal in all three
    are interchangeable).  A row belongs to the shard in which the middle byte of its size falls,
    so shard totals differ from the target by less than one row.  Size is the UTF-8 length plus
    one; a null text counts as length 0 and has no checksum.  An empty table gives no rows.
    Other columns are ignored, so their names cannot clash.
    """
    sizes = written(docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.encode(text, "UTF-8")), F.lit(0)) + 1).cast("long")
        .alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc")), "shard-sizes")
    order = [F.col("key").asc_nulls_first(), F.col("size").asc(), F.col("crc").asc_nulls_first()]
    placed = written(sizes.repartitionByRange(*order)
                     .withColumn("part", F.spark_partition_id()), "shard-ranges")
    # one line per range: as many as there are shuffle partitions, whatever the rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
              .select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"),
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
                      F.sum("bytes").over(Window.orderBy("part").rowsBetween(
                          Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")))
    within = Window.partitionBy("part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.withColumns({"upto": F.sum("size").over(running),
                              "nth": F.row_number().over(within)})
    located = cut.join(F.broadcast(totals), "part").select(
        "key", "size", "crc", (F.col("row0") + F.col("nth") - 1).alias("row"),
        F.expr(f"(2 * (byte0 + upto) - size) * {shards} div (2 * total)").cast("int")
        .alias("shard"))
    located = written(located, "shard-rows")
    firsts = located.groupBy("shard").agg(F.min("row").alias("first"))  # one line per shard
    return located.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("row") - F.col("first")).alias("slot"))
