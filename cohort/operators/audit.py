"""Audit events: builders, stamps, tamper evidence, and the check that no names leak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohort.functions.keyed import hmac_sha256
from cohort.functions.names import sanitized
from cohort.session import written

EVENT_SCHEMA = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("resource", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("output", T.StringType()),
        T.StructField("tags_removed", T.IntegerType()),
        T.StructField("tags_hashed", T.IntegerType())])),
    T.StructField("metadata", T.StructType([
        T.StructField("processing_time_ms", T.DoubleType())])),
])


def event(action: Column | str, resource: Column, actor: Column | str = "system",
          details: Column | None = None, error: Column | None = None,
          prediction: Column | None = None, confidence: Column | None = None,
          processing_time_ms: Column | None = None, output: Column | None = None,
          tags_removed: Column | None = None, tags_hashed: Column | None = None) -> Column:
    """One audit event without stamp; file names are hashed, figures rounded, the rest NULL."""
    def value(column, kind="string"):
        return (F.lit(None) if column is None else column).cast(kind)

    def text(x):
        return F.lit(x) if isinstance(x, str) else x

    has_result = any(c is not None for c in (prediction, output, tags_removed, tags_hashed))
    result = F.struct(
        value(prediction).alias("prediction"),
        F.round(value(confidence, "double"), 4).alias("confidence"),
        (value(None) if output is None else sanitized(output)).alias("output"),
        value(tags_removed, "int").alias("tags_removed"),
        value(tags_hashed, "int").alias("tags_hashed"))
    metadata = F.struct(F.round(value(processing_time_ms, "double"), 2)
                        .alias("processing_time_ms"))
    return F.struct(
        text(action).alias("action"), text(actor).alias("actor"),
        sanitized(resource).alias("resource"), value(details).alias("details"),
        value(error).alias("error"),
        F.when(value(error).isNotNull(), "error").alias("severity"),
        F.when(F.lit(has_result), result).alias("result"),
        F.when(F.lit(prediction is not None), metadata).alias("metadata"))


def stamped(df: DataFrame, column: str = "event", at: Column | None = None) -> DataFrame:
    """Events as rows with ``timestamp`` and a 16-digit ``event_id`` made from the content.

    A retried task writes the same id, so repeats can be dropped.
    """
    moment = at if at is not None else F.current_timestamp()
    flat = df.withColumn("timestamp", moment).select("timestamp", f"{column}.*")
    content = F.to_json(F.struct(*[F.col(f) for f in flat.columns]))
    return (flat.withColumn("event_id", F.substring(F.sha2(content, 256), 1, 16))
            .select(*[f.name for f in EVENT_SCHEMA.fields]))


def last_events(log: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` events, newest first."""
    return log.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


def _content(log: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(log.columns) if c != "mac"]))


def sealed(log: DataFrame, key: str) -> DataFrame:
    """Add ``mac``, a keyed hash of the whole event."""
    return log.withColumn("mac", hmac_sha256(key, _content(log)))


def broken_seals(log: DataFrame, key: str) -> DataFrame:
    """Events whose content no longer fits their ``mac``."""
    return log.where(~F.col("mac").eqNullSafe(hmac_sha256(key, _content(log))))


#: Columns that seals and links add to a log.
SEALS = ("mac", "link", "chunk")


def _linked_content(log: DataFrame, order: Sequence[str], ident: str) -> Column:
    """The event and the one before it in its chunk; a chunk is read in order, never gathered."""
    before = F.lag(ident).over(Window.partitionBy("chunk").orderBy(*order))
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(log.columns) if c not in SEALS]))
    return F.concat_ws("|", F.col("chunk").cast("string"), F.coalesce(before, F.lit("-")), content)


def linked(log: DataFrame, key: str, order: Sequence[str] = ("timestamp", "event_id"),
           ident: str = "event_id", chunk: str = "hour", ts: str = "timestamp") -> DataFrame:
    """Add ``chunk``, the event's hour (or other span), and ``link``, a keyed hash of the event and
    of the name of the one before it in the chunk.

    ``order`` has to tell all events of a chunk apart.
    """
    placed = log.withColumn("chunk", F.date_trunc(chunk, ts))
    return placed.withColumn("link", hmac_sha256(key, _linked_content(placed, order, ident)))


def chunk_roots(log: DataFrame, key: str) -> DataFrame:
    """(chunk, n, root, chain) of a linked log: a keyed hash of the sum of its links, and of the
    root together with that of the chunk before.

    Sums fold before the shuffle.  Chunks are spans of time, so their number does not grow with
    the rate of events; only their roots are chained, in one task.
    """
    words = [F.conv(F.substring("link", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
             for i in range(8)]
    sums = log.groupBy("chunk").agg(F.count("*").alias("n"), *(
        F.sum(w).alias(f"w{i}") for i, w in enumerate(words)))
    roots = sums.select("chunk", "n", hmac_sha256(key, F.concat_ws(
        "|", F.col("chunk").cast("string"), "n", *(f"w{i}" for i in range(8)))).alias("root"))
    return roots.withColumn("chain", _chain(key))


def _chain(key: str) -> Column:
    before = F.lag("root").over(Window.orderBy("chunk"))
    return hmac_sha256(key, F.concat_ws("|", F.coalesce(before, F.lit("-")), "root"))


def broken_links(log: DataFrame, key: str, order: Sequence[str] = ("timestamp", "event_id"),
                 ident: str = "event_id", chunk: str = "hour", ts: str = "timestamp") -> DataFrame:
    """Events that were changed or moved, or whose predecessor in the chunk is gone or new.

    The last events of a chunk leave no successor behind; ``broken_chunks`` counts them.
    """
    placed = log.withColumn("chunk", F.date_trunc(chunk, ts))
    return placed.withColumn(
        "_now", hmac_sha256(key, _linked_content(placed, order, ident))).where(
        ~F.col("link").eqNullSafe(F.col("_now"))).drop("_now")


def broken_chunks(log: DataFrame, roots: DataFrame, key: str, chunk: str = "hour",
                  ts: str = "timestamp") -> DataFrame:
    """(chunk, n, found, fault) where a log no longer fits the roots that were kept apart from it.

    ``fault`` is ``missing`` or ``added`` events, ``changed`` ones, or ``chain`` where the root
    does not follow the one before it, as when a chunk is taken out of both log and roots.
    """
    now = chunk_roots(log.withColumn("chunk", F.date_trunc(chunk, ts)), key).select(
        "chunk", F.col("n").alias("found"), F.col("root").alias("now"))
    kept = roots.withColumn("follows", F.col("chain") == _chain(key))
    both = kept.join(now, "chunk", "full")
    n, found = F.coalesce("n", F.lit(0)), F.coalesce("found", F.lit(0))
    fault = (F.when(found < n, "missing").when(found > n, "added")
             .when(F.col("root") != F.col("now"), "changed").when(~F.col("follows"), "chain"))
    return both.select("chunk", n.alias("n"), found.alias("found"), fault.alias("fault")).where(
        F.col("fault").isNotNull())


def leaked_values(log: DataFrame, text: str, values: DataFrame, value: str) -> DataFrame:
    """Log rows that contain any of the protected values, with the value.

    Values fall into classes by length (1, 2 to 3, 4 to 7, ...).  A class is looked up by its
    shortest length: every piece of that length in the text meets the values that begin with it,
    and what follows is compared in place.  So a text makes about one line per character and
    class, however many lengths there are.  A line carries the text as far as a value of its class
    reaches.  Values may be as many as rows, so both joins are merge joins: a broadcast would pass
    them all through the driver.
    """
    wanted = values.where(F.length(value) > 0).select(F.col(value).alias("leaked")).distinct()
    wanted = wanted.withColumn("_size", F.floor(F.log2(F.length("leaked"))).cast("int"))
    # at most 31 classes, whatever the values
    classes = sorted(r[0] for r in wanted.select("_size").distinct().collect())
    if not classes:
        return log.withColumn("leaked", F.lit(None).cast("string")).limit(0)

    def pieces(size: int) -> Column:
        n = 2 ** size
        starts = F.when(F.length(text) >= n, F.sequence(
            F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            F.lit(size).alias("_size"),
            F.substring(F.col(text), i, F.lit(2 * n - 1)).alias("_reach")))

    def key(size: str, of: str) -> Column:
        begins = F.substring(F.col(of), F.lit(1), F.pow(F.lit(2), F.col(size)).cast("int"))
        return F.xxhash64(size, begins)

    rows = written(log.withColumn("_row", F.monotonically_increasing_id()), "log-rows")
    placed = rows.select("_row", F.explode(F.concat(*[pieces(s) for s in classes])).alias(
        "_p")).select("_row", "_p.*").withColumn("_key", key("_size", "_reach"))
    keyed = wanted.withColumn("_key", key("_size", "leaked")).drop("_size")
    hits = (placed.join(keyed.hint("merge"), "_key")
            .where(F.startswith(F.col("_reach"), F.col("leaked")))
            .select("_row", "leaked").distinct())
    return rows.join(hits.hint("merge"), "_row").drop("_row")
