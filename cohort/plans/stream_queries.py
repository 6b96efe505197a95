"""Event timelines as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import pairs, timelines, validate
from cohort.operators.fingerprint import text_print
from cohort.plans.inputs import (BITS, DISTANCE, PRINTS_SQL, fingerprints, rounded,
                                 table)
from cohort.plans.privacy_queries import ACTIONS_SQL, audit_events
from cohort.plans.profile_queries import REASONS_SQL, uploads
from cohort.plans.registry import query
from cohort.session import scratch_path, written
from cohort.sources import logs
from cohort.streaming import arrivals, feeds, intake, stateful
from cohort.streaming.jobs import run_available, with_end


def stream_of(spark, folder, name):
    """A given table, one file or a folder of them, as a file stream.

    The path is a pattern, as a stream takes the plain path of a folder only.
    """
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def closed_stream_of(spark, folder, name, shape):
    """The same in another shape, with a row behind the end that closes what is open."""
    end = table(spark, folder, name).agg(F.max("ts")).head()[0]
    return with_end(shape(stream_of(spark, folder, name)), end)


def _predictions(events):
    return events.select(F.col("ts").cast("timestamp").alias("ts"),
                         F.col("event_type").alias("class"),
                         (F.col("value") / 500).alias("confidence"),
                         F.col("value").alias("latency_ms"))


MONITOR_SQL = """monitored AS (
  SELECT epoch_us(date_trunc('day', ts)) AS window_start, event_type AS class, count(*) AS n,
    round(avg(value / 500), 10) AS mean_confidence,
    quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
  FROM events GROUP BY 1, 2)"""


def _shown(monitored):
    return rounded(monitored.withColumn("window_start", F.unix_micros("window_start")),
                   "mean_confidence", digits=10)


@query("st3_monitor", f"WITH {MONITOR_SQL} SELECT * FROM monitored")
def monitor(spark, folder):
    return _shown(timelines.monitor(_predictions(table(spark, folder, "events")), "1 day"))


@query("st3_monitor_stream", f"WITH {MONITOR_SQL} SELECT * FROM monitored")
def monitor_stream(spark, folder):
    """All windows; the end of the input closes the last ones."""
    stream = feeds.monitored(closed_stream_of(spark, folder, "events", _predictions), "1 day")
    return _shown(run_available(stream, "monitor"))


@query("st2_audit_stream", f"""WITH {ACTIONS_SQL}
SELECT epoch_us(timestamp) AS at, actor, action, resource FROM logged""")
def audit_stream(spark, folder):
    """Every event arrives twice and is written once."""
    source = scratch_path(spark, "audit-source")
    events = written(audit_events(spark, folder), "audit-events")
    events.unionByName(events).write.parquet(source)
    path = scratch_path(spark, "audit-sink")
    feeds.audit_sink(spark.readStream.schema(events.schema).parquet(source), path,
                     f"{path}-progress").awaitTermination()
    return logs.read_events(spark, path).select(F.unix_micros("timestamp").alias("at"),
                                                "actor", "action", "resource")


SESSIONS_SQL = """gaps AS (
  SELECT user_id AS actor, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1
    END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY actor ORDER BY ts
    ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
found AS (
  SELECT actor, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS last_event,
    count(*) AS events FROM numbered GROUP BY actor, session)"""


def _actors(events):
    return events.select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp"))


def _micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query("st6_sessions", f"WITH {SESSIONS_SQL} SELECT * FROM found")
def sessions(spark, folder):
    found = timelines.sessions(_actors(table(spark, folder, "events")))
    return _micros(found, "session_start", "last_event")


@query("st6_sessions_stream", f"WITH {SESSIONS_SQL} SELECT * FROM found")
def sessions_stream(spark, folder):
    """All sessions; the end of the input closes the last ones."""
    stream = feeds.streamed_sessions(closed_stream_of(spark, folder, "events", _actors))
    return _micros(run_available(stream, "sessions"), "session_start", "last_event")


def _requests(events):
    return events.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp"))


@query("st4_busy_windows", """SELECT user_id AS client, epoch_us(date_trunc('hour', ts)) AS hour,
  count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2""")
def busy_windows(spark, folder):
    """The simple form of the limit, per hour because the events are sparse."""
    hourly = _requests(table(spark, folder, "events")).withColumn(
        "ts", F.date_trunc("hour", "ts"))
    busy = timelines.busy_seconds(hourly, 2)
    return busy.select("client", F.unix_micros("second").alias("hour"), "n")


BUCKET_SQL = """RECURSIVE counted AS (
  SELECT user_id % 5 AS client, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM events GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ms) AS i FROM counted),
step AS (
  SELECT client, i, ms, n, least(n, 3)::BIGINT AS passed,
    least(n, 3) - 1.0::DOUBLE AS level, ms AS last FROM numbered WHERE i = 1
  UNION ALL
  SELECT client, i, ms, n,
    passed, CASE WHEN passed > 0 THEN first + passed - 1 ELSE level END,
    CASE WHEN passed > 0 THEN ms ELSE last END
  FROM (
    SELECT *, CASE WHEN first > 2 THEN 0 ELSE least(n, floor(2 - first) + 1) END::BIGINT
      AS passed
    FROM (
      SELECT m.client, m.i, m.ms, m.n, s.level, s.last, greatest(0.0::DOUBLE,
        s.level - 0.001::DOUBLE * (m.ms - s.last) / 1000.0::DOUBLE + 1.0::DOUBLE) AS first
      FROM step s JOIN numbered m ON m.client = s.client AND m.i = s.i + 1))),
refusals AS (SELECT client, ms * 1000 AS at, n, n - passed AS refused FROM step
  WHERE passed < n)"""


def _few_clients(events):
    """Five clients, each busy enough to be refused now and then."""
    return _requests(events).withColumn("client", F.col("client") % 5)


@query("st4_rate_breaches", f"WITH {BUCKET_SQL} SELECT * FROM refusals")
def rate_breaches(spark, folder):
    """One request per 1000 s and a burst of 2: the events are sparse, the rule is the same."""
    found = timelines.rate_breaches(_few_clients(table(spark, folder, "events")), 0.001, 2)
    return _micros(found, "at")


@query("st4_rate_breaches_stream", f"WITH {BUCKET_SQL} SELECT * FROM refusals")
def rate_breaches_stream(spark, folder):
    stream = stateful.streamed_breaches(
        closed_stream_of(spark, folder, "events", _few_clients), 0.001, 2)
    return _micros(run_available(stream, "breaches"), "at")


def _probes(events):
    return events.select((F.col("user_id") % 5).alias("target"),
                         F.col("ts").cast("timestamp"),
                         (F.col("event_type") != "error").alias("ok"))


FLAP_SQL = """probe AS (
  SELECT user_id % 5 AS target, epoch_us(ts) AS us, event_type <> 'error' AS ok FROM events),
runs AS (
  SELECT *, max(us) FILTER (ok) OVER (PARTITION BY target ORDER BY us
      ROWS UNBOUNDED PRECEDING) AS good, min(us) OVER (PARTITION BY target) AS begun FROM probe),
failed AS (
  SELECT *, row_number() OVER (PARTITION BY target, good ORDER BY us) AS nth
  FROM runs WHERE NOT ok AND us - begun >= 60000000),
spans AS (
  SELECT target, good, min(us) AS first_failure, max(us) FILTER (nth = 3) AS unhealthy_from,
    max(us) AS last_failure, count(*) AS failures
  FROM failed GROUP BY target, good HAVING count(*) >= 3)"""


@query("st5_flapping", f"""WITH {FLAP_SQL}
SELECT target, first_failure, unhealthy_from, last_failure, failures FROM spans""")
def flapping(spark, folder):
    spans = timelines.unhealthy_spans(_probes(table(spark, folder, "events")))
    return _micros(spans, "first_failure", "unhealthy_from", "last_failure")


@query("st5_flapping_stream", f"""WITH {FLAP_SQL}
SELECT target, unhealthy_from AS at, false AS healthy FROM spans
UNION ALL
SELECT target, back, true FROM (
  SELECT s.target, (SELECT min(p.us) FROM probe p WHERE p.target = s.target AND p.ok
    AND p.us > s.last_failure) AS back FROM spans s) WHERE back IS NOT NULL""")
def flapping_stream(spark, folder):
    changes = stateful.health_changes(closed_stream_of(spark, folder, "events", _probes))
    return _micros(run_available(changes, "health"), "at")


@query("st1_arrivals", f"""WITH {PRINTS_SQL},
known AS (SELECT print, w, min(id) AS first, count(*) AS n FROM prints
  WHERE original_split = 'train' AND print IS NOT NULL GROUP BY print, w)
SELECT p.id, p.print, k.print AS known_print, k.first AS known_first, k.n AS known_members,
  bit_count(xor(p.w, k.w))::INT AS distance
FROM prints p JOIN known k ON bit_count(xor(p.w, k.w)) <= 3 WHERE p.original_split = 'test'""")
def arriving(spark, folder):
    """Test documents arrive as a stream and meet the known train documents."""
    train = fingerprints(spark, folder).where(F.col("original_split") == "train")
    known, refined = arrivals.known_bands(pairs.print_groups(train, "id"), BITS, DISTANCE)
    even = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0
    stream = stream_of(spark, folder, "documents").where(~even).select(
        F.col("doc_id").alias("id"), text_print(F.col("text")).alias("print"))
    found = arrivals.arriving_duplicates(stream, "id", known, refined, BITS, DISTANCE)
    return run_available(found, "arrivals")


@query("st1_dead_letters", f"""WITH {REASONS_SQL}
SELECT id, filename, reason FROM reasons WHERE reason IS NOT NULL""")
def dead_letters(spark, folder):
    """Arriving uploads that are refused, each with the first rule it breaks."""
    arriving_uploads = uploads(stream_of(spark, folder, "documents"))
    reason = validate.reject_reason(F.col("filename"), F.col("content_type"), F.col("size"),
                                    F.col("decodable"))
    checked = arriving_uploads.select("id", "filename", reason.alias("reason"))
    return run_available(validate.dead_letters(checked), "dead-letters")


INTAKE_SQL = REASONS_SQL + ", " + PRINTS_SQL + """,
known AS (SELECT w, count(*) AS n FROM prints
  WHERE original_split = 'train' AND print IS NOT NULL GROUP BY w),
near AS (SELECT p.id, count(*) AS known_prints, sum(k.n)::BIGINT AS known_rows
  FROM prints p JOIN known k ON bit_count(xor(p.w, k.w)) <= 3 GROUP BY p.id)"""


@query("st1_intake", f"""WITH {INTAKE_SQL}
SELECT r.id, r.filename, r.reason, CASE WHEN r.reason IS NULL THEN p.print END AS print,
  CASE WHEN r.reason IS NULL THEN coalesce(n.known_prints, 0) END AS known_prints,
  CASE WHEN r.reason IS NULL THEN coalesce(n.known_rows, 0) END AS known_rows
FROM reasons r JOIN prints p USING (id) LEFT JOIN near n USING (id)""")
def upload_intake(spark, folder):
    """Documents arrive as uploads: checked, fingerprinted and looked up among known ones, by
    batches that write their own folders; each upload's outcome is read back from there."""
    train = fingerprints(spark, folder).where(F.col("original_split") == "train")
    known, refined = arrivals.known_bands(pairs.print_groups(train, "id"), BITS, DISTANCE)
    out = scratch_path(spark, "intake")

    def check(batch):
        named = uploads(batch, "text")
        reason = validate.reject_reason(F.col("filename"), F.col("content_type"), F.col("size"),
                                        F.col("decodable"))
        shown = F.when(F.col("reason").isNull(), text_print(F.when(
            F.col("reason").isNull(), F.col("text"))))
        return named.select("id", "filename", reason.alias("reason"), "text").select(
            "id", "filename", "reason", shown.alias("print"))

    intake.intake(stream_of(spark, folder, "documents"), "id", check, known, refined, out,
                  f"{out}-progress", BITS, DISTANCE).awaitTermination()
    near = intake.matches(spark, out).groupBy("id").agg(
        F.count("*").alias("known_prints"), F.sum("known_members").alias("known_rows"))
    fine = intake.accepted(spark, out).join(near, "id", "left").select(
        "id", "filename", F.lit(None).cast("string").alias("reason"), "print",
        F.coalesce("known_prints", F.lit(0)).alias("known_prints"),
        F.coalesce("known_rows", F.lit(0)).alias("known_rows"))
    return fine.unionByName(intake.rejected(spark, out).select("id", "filename", "reason"),
                            allowMissingColumns=True)


OUTCOMES_SQL = """dealt AS (
  SELECT event_id, ts, user_id % 7 = 0 AS held, user_id % 11 = 0 AS twice,
    ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS early FROM events),
arriving AS (
  SELECT 0 AS batch, event_id, ts FROM dealt WHERE early AND NOT held
  UNION ALL SELECT 1, event_id, ts FROM dealt WHERE NOT early AND NOT held
  UNION ALL SELECT 1, event_id, ts FROM dealt WHERE early AND NOT held AND twice
  UNION ALL SELECT 2, event_id, ts FROM dealt WHERE held),
marks AS (
  SELECT b AS batch, (SELECT epoch_ms(max(ts)) FROM arriving WHERE batch < b) - 86400000 AS mark
  FROM range(3) t(b)),
decided AS (
  SELECT batch, event_id, ts, CASE WHEN epoch_ms(ts) < mark THEN 'late'
    WHEN row_number() OVER (PARTITION BY event_id, coalesce(epoch_ms(ts) < mark, false)
      ORDER BY batch) > 1 THEN 'repeated' ELSE 'kept' END AS outcome
  FROM arriving JOIN marks USING (batch))"""


@query("st7_outcomes", f"""WITH {OUTCOMES_SQL}
SELECT batch, event_id, epoch_us(ts) AS at, outcome FROM decided""")
def late_and_repeated(spark, folder):
    """Events in three batches, some repeated and some held back: kept, late or repeated.

    The stream is stopped after each batch and goes on from its checkpoint.
    """
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).head()
    early = F.col("ts") < F.lit(span["low"] + (span["high"] - span["low"]) / 2)
    held, twice = F.col("user_id") % 7 == 0, F.col("user_id") % 11 == 0
    source, out = scratch_path(spark, "feed"), scratch_path(spark, "outcomes")
    shape = events.select("event_id", "ts")
    for part in (early & ~held, ~held & (~early | twice), held):
        events.where(part).select("event_id", "ts").write.mode("append").parquet(source)
        feed = spark.readStream.schema(shape.schema).parquet(source)
        intake.reconciled(feed, out, f"{out}-progress", 86_400_000, "event_id",
                          "ts").awaitTermination()
    return intake.outcomes(spark, out).select(
        F.col("batch").cast("int").alias("batch"), "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "outcome")


@query("st3_merged_quantiles", """SELECT epoch_us(date_trunc('day', ts)) AS day,
  event_type AS class, count(*) AS n, round(avg(value / 500), 10) AS mean_confidence,
  true AS p50_near, true AS p95_near FROM events GROUP BY 1, 2""")
def merged_quantiles(spark, folder):
    """Days merged from the sketches of an hourly stream; the ranks of the quantiles they give are
    looked up among all rows of the day and lie within twice the stated error."""
    events = table(spark, folder, "events")
    stream = closed_stream_of(spark, folder, "events", _predictions).withWatermark("ts", "1 hour")
    hours = run_available(timelines.latency_sketches(stream, "1 hour"), "sketches")
    days = written(timelines.merged_sketches(hours, "day"), "days")
    ranks = (_predictions(events).withColumn("unit_start", F.date_trunc("day", "ts"))
             .join(days.select("unit_start", "class", "quantiles"), ["unit_start", "class"])
             .groupBy("unit_start", "class").agg(*(
                 F.avg((F.col("latency_ms") < F.col("quantiles")[i]).cast("double")).alias(f"lo{i}")
                 for i in (0, 1)), *(
                 F.avg((F.col("latency_ms") <= F.col("quantiles")[i]).cast("double"))
                 .alias(f"hi{i}") for i in (0, 1))))

    def near(i, q):
        room = 2 * timelines.RANK_ERROR
        return (F.col(f"lo{i}") <= q + room) & (F.col(f"hi{i}") >= q - room)

    rows = days.join(ranks, ["unit_start", "class"]).select(
        F.unix_micros("unit_start").alias("day"), "class", "n", "mean_confidence",
        near(0, 0.5).alias("p50_near"), near(1, 0.95).alias("p95_near"))
    return rounded(rows, "mean_confidence", digits=10)
