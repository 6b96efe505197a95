"""Audit log as JSON lines and the access log of a proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohort.operators.audit import EVENT_SCHEMA

# Pattern and time format of the access log, ISO time of audit events.
ACCESS_LINE = (r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\d+) "([^"]*)" "([^"]*)" '
               r'rt=([\d.]+)$')
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").option("timestampFormat", EVENT_TIME).json(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Events of a log; lines that are not JSON are skipped."""
    return (spark.read.schema(schema).option("mode", "DROPMALFORMED")
            .option("timestampFormat", EVENT_TIME).json(path))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that :func:`read_events` skips."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull())


def parse_access_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of access-log lines; the others come from :func:`rejected_access_lines`."""
    # an array in between keeps the fields from being split off the line once each
    return lines.select(F.explode(F.array(_access_record(column))).alias("p")).where(
        _complete("p")).select("p.*")


def _access_record(column: str) -> Column:
    """The nine fields as a record, null where the line has another form or no such value exists."""
    fields = _access_fields(column)

    def part(i):
        return F.get(fields, F.lit(i - 1))

    return F.when(F.size(fields) == 9, F.struct(
        part(1).alias("remote_addr"), part(2).alias("remote_user"),
        F.try_to_timestamp(part(3), F.lit(ACCESS_TIME)).alias("ts"), part(4).alias("request"),
        part(5).try_cast("int").alias("status"), part(6).try_cast("bigint").alias("bytes"),
        part(7).alias("referer"), part(8).alias("user_agent"),
        part(9).try_cast("double").alias("request_time")))


def _complete(record: str) -> Column:
    """No impossible date and no number that is not one or does not fit."""
    return F.col(f"{record}.ts").isNotNull() & F.col(f"{record}.status").isNotNull() & F.col(
        f"{record}.bytes").isNotNull() & F.col(f"{record}.request_time").isNotNull()


def _access_fields(column: str) -> Column:
    """The nine fields of a line in one pass; a line of another form is one field.

    A line that itself holds the sign put between the fields is taken apart field by field.
    """
    mark = "\u0001"
    joined = F.regexp_replace(column, ACCESS_LINE, mark.join(f"${i}" for i in range(1, 10)))
    singly = F.when(F.rlike(F.col(column), F.lit(ACCESS_LINE)), F.array(*(
        F.regexp_extract(column, ACCESS_LINE, i) for i in range(1, 10)))).otherwise(
        F.array(F.col(column)))
    return F.when(F.col(column).contains(mark), singly).otherwise(F.split(joined, mark))


def rejected_access_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that :func:`parse_access_lines` leaves out, null ones too."""
    checked = lines.withColumn("_p", F.explode(F.array(_access_record(column))))
    return checked.where(~F.coalesce(_complete("_p"), F.lit(False))).select(column)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_lines(spark.read.text(path))
