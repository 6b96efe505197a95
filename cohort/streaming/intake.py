"""Streams that write by batch: uploads checked on arrival, and late or repeated events.

A batch writes into folders of its own, named by its number, and overwrites them if it is run
again, so a restart between two writes leaves each row once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cohort.functions.names import IMAGE_EXTENSIONS
from cohort.operators.fingerprint import image_prints
from cohort.operators.pairs import THRESHOLD
from cohort.operators.validate import reject_reason
from cohort.sources.images import decode_images, with_place
from cohort.streaming.arrivals import arriving_duplicates

#: Files of one batch; their names, not their content, pass through the driver.
BATCH_FILES = 1000


def arriving_files(spark: SparkSession, folder: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """Stream of the path and length of each file of a folder tree; content is not read here.

    Spark's file sources show no files of length zero.
    """
    return (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", batch_files)
            .schema("path string, modificationTime timestamp, length bigint, content binary")
            .load(folder).select("path", "length"))


def checked_images(files: DataFrame) -> DataFrame:
    """(path, length, label, original_split, reason, print) of one batch of files.

    Name and length are checked first; only files that pass are read, decoded in full and
    fingerprinted, in the same tasks.
    """
    first = files.withColumn("reason", reject_reason(
        F.col("path"), F.lit(None).cast("string"), F.col("length"), F.lit(True)))
    refused = with_place(first.where(F.col("reason").isNotNull())).withColumn(
        "print", F.lit(None).cast("string"))
    paths = [r["path"] for r in first.where(F.col("reason").isNull()).select("path").collect()]
    if not paths:
        return refused
    # characters of a pattern stand for themselves in the name of a file
    names = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    decoded = image_prints(decode_images(files.sparkSession, names, IMAGE_EXTENSIONS))
    done = first.where(F.col("reason").isNull()).drop("reason").join(
        decoded.select(_slashes(F.col("path")).alias("_name"), "print"),
        _slashes(F.col("path")) == F.col("_name"), "left").drop("_name")
    return refused.unionByName(with_place(done).withColumn("reason", F.when(
        F.col("print").isNull(), "could not open image")))


def _slashes(path: Column) -> Column:
    """A path with one slash behind its scheme; the two sources write one or three."""
    return F.regexp_replace(path, "^([a-z][a-z0-9+.-]*):/+", "$1:/")


def intake(arrivals: DataFrame, key: str, check: Callable[[DataFrame], DataFrame],
           known: DataFrame, refined: bool, folder: str, checkpoint: str, bits: int = 256,
           threshold: int = THRESHOLD) -> StreamingQuery:
    """Check arriving rows, and look up those accepted among the known fingerprints.

    ``check`` turns a batch into rows with ``key``, ``reason`` (null: accepted) and ``print``; it
    runs once per batch.  Each batch writes ``checked/batch=N/accepted=true|false`` and
    ``matches/batch=N``; see ``accepted``, ``rejected`` and ``matches``.
    """
    def run(batch: DataFrame, number: int) -> None:
        here = f"{folder}/checked/batch={number}"
        rows = check(batch)
        rows.withColumn("accepted", F.col("reason").isNull()).write.mode("overwrite").partitionBy(
            "accepted").parquet(here)
        fine = (batch.sparkSession.read.schema(_with(rows, "accepted", T.BooleanType()))
                .parquet(here).where("accepted"))
        arriving_duplicates(fine, key, known, refined, bits, threshold).write.mode(
            "overwrite").parquet(f"{folder}/matches/batch={number}")

    return (arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _with(rows: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField(name, kind)])


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/checked").where("accepted = 'true'").drop(
        "accepted", "reason")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/checked").where("accepted = 'false'").drop(
        "accepted", "print")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/matches")


def reconciled(events: DataFrame, folder: str, checkpoint: str, delay_ms: int,
               key: str = "event_id", ts: str = "timestamp") -> StreamingQuery:
    """Deal each arriving event to ``outcome=kept``, ``late`` or ``repeated``.

    Late is an event more than ``delay_ms`` behind the latest one of the batches before; repeated
    is one whose key an earlier batch kept with a time that is not late by now, or another row of
    its batch with that key (the earliest stays).  Both are decided against what earlier batches have written, so no row is lost: kept,
    late and repeated rows add up to the input.  A null time is late, null keys are never repeats.

    The mark of each batch is written with it.  Keys are looked up only in batches that reach
    beyond the mark, as all older rows are late.
    """
    shown = _with(events, "outcome", T.StringType())
    kind = events.schema[ts].dataType

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _before(spark, f"{folder}/marks", number)
        latest = max((m["latest"] for m in marks if m["latest"] is not None), default=None)
        mark = F.lit(None).cast("bigint") if latest is None else F.lit(latest - delay_ms)
        millis = F.unix_millis(F.col(ts).cast("timestamp"))
        late = F.col(ts).isNull() | F.coalesce(millis < mark, F.lit(False))
        rows = batch.withColumn("_late", late)
        from_late = rows.where("_late").drop("_late").withColumn("outcome", F.lit("late"))
        timely = rows.where("NOT _late").drop("_late")
        # the earliest row of a key; among equal times any, they are told apart by a draw
        draw = F.monotonically_increasing_id()
        numbered = timely.withColumn("_draw", draw)
        named = numbered.where(F.col(key).isNotNull())
        first = named.groupBy(F.col(key).alias("_key")).agg(
            F.min_by("_draw", F.struct(F.col(ts), F.col("_draw"))).alias("_first"))
        near = [f"{folder}/events/batch={m['batch']}" for m in marks
                if m["latest"] is not None and m["latest"] >= latest - delay_ms]
        if near:
            kept = (spark.read.schema(shown).parquet(*near)
                    .where((F.col("outcome") == "kept") & F.col(key).isNotNull()
                           & (F.unix_millis(F.col(ts).cast("timestamp")) >= mark)))
            first = first.join(kept.select(F.col(key).alias("_key")).distinct(), "_key",
                               "left_anti")
        repeated = F.col(key).isNotNull() & ~F.coalesce(F.col("_first") == F.col("_draw"),
                                                        F.lit(False))
        dealt = numbered.join(first, F.col(key) == F.col("_key"), "left").withColumn(
            "outcome", F.when(repeated, "repeated").otherwise("kept"))
        dealt = dealt.select(*batch.columns, "outcome").unionByName(from_late)
        dealt.write.mode("overwrite").partitionBy("outcome").parquet(
            f"{folder}/events/batch={number}")
        written = spark.read.schema(shown).parquet(f"{folder}/events/batch={number}")
        written.groupBy().agg(
            F.max(F.when(F.col("outcome") != "late", millis)).alias("latest"),
            *(F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "late", "repeated"))
        ).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    if kind.typeName() not in ("timestamp", "timestamp_ntz"):
        raise ValueError(f"{ts} has to be a time")
    return (events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _before(spark: SparkSession, marks: str, number: int) -> list:
    """The marks of the batches before ``number``: one small row each."""
    if number == 0:
        return []
    return (spark.read.schema("latest bigint, batch bigint").parquet(marks)
            .where(F.col("batch") < number).collect())


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """All events with their ``outcome`` and ``batch``."""
    return spark.read.parquet(f"{folder}/events")


def batch_report(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, kept, late, repeated) from the marks, without reading the events."""
    return spark.read.schema(
        "latest bigint, kept bigint, late bigint, repeated bigint, batch bigint").parquet(
        f"{folder}/marks").select("batch", "kept", "late", "repeated")
