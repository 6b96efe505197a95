"""De-identification, encryption, audit and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import audit, metrics, pairs, privacy
from cohort.plans.duplicate_queries import label_pairs
from cohort.plans.evaluation_queries import TOPIC_NAMES
from cohort.plans.inputs import (CONFUSION_SQL, GROUPS_SQL, SALT, TOPICS, fingerprints,
                                 predictions, predictions_sql, rounded, table)
from cohort.plans.registry import query
from cohort.session import scratch_path, written
from cohort.sources import logs, tables

PASSWORD = "correct horse battery staple"


def hmac_sql(key: str, value: str) -> str:
    padded = key.encode().ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in padded).hex()
    outer = bytes(b ^ 0x5C for b in padded).hex()
    return (f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || "
            f"encode({value}))))")


UID_SQL = "'2.25.' || substr({}, 1, 60)"


@query("d1_deidentify", f"""SELECT CASE WHEN c_name IS NOT NULL THEN '' END AS c_name,
  {UID_SQL.format(hmac_sql(SALT, 'c_custkey::VARCHAR'))} AS c_custkey, c_nationkey, c_acctbal,
  c_mktsegment FROM customer""")
def deidentify(spark, folder):
    return privacy.deidentify_columns(table(spark, folder, "customer"), SALT, ["c_name"],
                                      ["c_custkey"])


@query("d2_keyed_hash", f"""SELECT o_orderkey,
  {UID_SQL.format(hmac_sql(SALT, 'o_custkey::VARCHAR'))} AS uid FROM orders""")
def keyed_hash(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", privacy.keyed_uid(F.col("o_custkey").cast("string"), SALT).alias("uid"))


def _headers(spark, folder):
    tags = F.when(F.col("c_custkey") % 50 != 0, F.create_map(
        F.lit("PatientName"), F.col("c_name"),
        F.lit("PatientID"), F.col("c_custkey").cast("string"),
        F.lit("StudyInstanceUID"), F.concat(F.lit("1.2.840."), "c_custkey"),
        F.lit("Modality"), F.col("c_mktsegment")))
    return table(spark, folder, "customer").select("c_custkey", tags.alias("tags"))


@query("d3_change_report", f"""SELECT c_custkey,
  CASE WHEN has THEN '' END AS patient_name,
  CASE WHEN has THEN {UID_SQL.format(hmac_sql(SALT, "'1.2.840.' || c_custkey"))} END AS study,
  CASE WHEN has THEN c_mktsegment END AS modality,
  CASE WHEN has THEN 'PatientName:' || length(c_name) || ',PatientID:'
    || length(c_custkey::VARCHAR) END AS removed,
  CASE WHEN has THEN 'StudyInstanceUID:' || substr('1.2.840.' || c_custkey, 1, 8) || '...'
    || substr({UID_SQL.format(hmac_sql(SALT, "'1.2.840.' || c_custkey"))}, 1, 16) || '...'
  END AS hashed,
  CASE WHEN NOT has THEN 'header could not be read' END AS error
FROM (SELECT *, c_custkey % 50 <> 0 AS has FROM customer)""")
def change_report(spark, folder):
    done = privacy.deidentify_tags(_headers(spark, folder), SALT)
    removed = F.transform("removed", lambda r: F.concat_ws(":", r["tag"], r["original_length"]))
    hashed = F.transform("hashed", lambda r: F.concat(
        r["tag"], F.lit(":"), r["original_prefix"], r["hashed_prefix"]))
    seen = F.col("tags").isNotNull()
    return done.select(
        "c_custkey", F.col("tags")["PatientName"].alias("patient_name"),
        F.col("tags")["StudyInstanceUID"].alias("study"),
        F.col("tags")["Modality"].alias("modality"),
        F.when(seen, F.array_join(removed, ",")).alias("removed"),
        F.when(seen, F.array_join(hashed, ",")).alias("hashed"), "error")


@query("d4_error_summary", """SELECT coalesce(CASE WHEN c_custkey % 50 = 0
  THEN 'header could not be read' END, 'ok') AS outcome, count(*) AS n
FROM customer GROUP BY 1""")
def error_summary(spark, folder):
    done = privacy.deidentify_tags(_headers(spark, folder), SALT)
    return done.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("n"))


@query("d5_linkage", """SELECT stage, count(*) AS joined_rows,
  count(DISTINCT c_custkey) AS linked_keys
FROM customer JOIN orders ON o_custkey = c_custkey, (VALUES ('before'), ('after')) s(stage)
GROUP BY stage""")
def linkage(spark, folder):
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    before = privacy.linkage_counts(customers, orders, "c_custkey", "o_custkey")
    after = privacy.linkage_counts(
        privacy.deidentify_columns(customers, SALT, ["c_name"], ["c_custkey"]),
        privacy.deidentify_columns(orders, SALT, [], ["o_custkey"]), "c_custkey", "o_custkey")
    return before.withColumn("stage", F.lit("before")).unionByName(
        after.withColumn("stage", F.lit("after")))


@query("d6_encrypt_roundtrip", """SELECT conv_id, turn, text,
  strlen(text) + 44 AS blob_length FROM conversations""")
def encrypt_roundtrip(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    blobs = privacy.encrypt(rows, "text", PASSWORD).withColumn(
        "blob_length", F.length("text").cast("bigint"))
    return privacy.decrypt(blobs, "text", PASSWORD).withColumn(
        "text", F.col("text").cast("string"))


@query("d7_tampered", """SELECT count(*) AS rows, count(*) FILTER (conv_id % 3 = 0) AS rejected
FROM conversations""")
def tampered(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "text")
    blobs = privacy.encrypt(rows, "text", PASSWORD)
    cut = F.expr("concat(substring(text, 1, length(text) - 1), "
                 "unhex(hex(255 - conv(hex(substring(text, length(text), 1)), 16, 10))))")
    broken = blobs.withColumn("text", F.when(F.col("conv_id") % 3 == 0, cut)
                              .otherwise(F.col("text")))
    opened = privacy.decrypt(broken, "text", PASSWORD, strict=False)
    return opened.agg(F.count("*").alias("rows"),
                      F.count_if(F.col("text").isNull()).alias("rejected"))


ACTIONS_SQL = """kinds AS (
  SELECT event_id, ts, 'user' || user_id AS actor, event_type, value,
    'JohnDoe_' || event_id || '.dcm' AS file FROM events),
logged AS (
  SELECT event_id AS id, ts AS timestamp, actor, CASE event_type WHEN 'view' THEN 'data_read'
      WHEN 'click' THEN 'anonymize' WHEN 'signup' THEN 'encrypt' WHEN 'error' THEN 'predict'
      ELSE 'predict' END AS action,
    substr(sha256('JohnDoe_' || event_id), 1, 12) || '.dcm' AS resource,
    CASE WHEN event_type = 'error' THEN 'failed' END AS error,
    CASE WHEN event_type = 'error' THEN 'error' END AS severity,
    CASE WHEN event_type = 'purchase' THEN 'class' || (event_id % 4) END AS prediction,
    CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS processing_time_ms,
    CASE WHEN event_type = 'click' THEN 25 END AS tags_removed
  FROM kinds)"""


def audit_events(spark, folder):
    """Audit log made from the event table: one builder per event type."""
    rows = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"),
        F.concat(F.lit("user"), "user_id").alias("actor"), "event_type", "value",
        F.concat(F.lit("JohnDoe_"), "event_id", F.lit(".dcm")).alias("file"))
    file, actor = F.col("file"), F.col("actor")
    kind = F.col("event_type")
    built = (
        F.when(kind == "view", audit.event("data_read", file, actor))
        .when(kind == "click", audit.event("anonymize", file, actor, output=file,
                                           tags_removed=F.lit(25), tags_hashed=F.lit(5)))
        .when(kind == "signup", audit.event("encrypt", file, actor))
        .when(kind == "error", audit.event("predict", file, actor, error=F.lit("failed")))
        .otherwise(audit.event(
            "predict", file, actor,
            prediction=F.concat(F.lit("class"), F.col("event_id") % 4),
            confidence=F.lit(0.9), processing_time_ms=F.col("value"))))
    return audit.stamped(rows.select("at", built.alias("event")), "event", F.col("at"))


def _flat():
    return [F.unix_micros("timestamp").alias("at"), "actor", "action", "resource", "error",
            "severity", F.col("result.prediction").alias("prediction"),
            F.col("metadata.processing_time_ms").alias("processing_time_ms"),
            F.col("result.tags_removed").alias("tags_removed")]


_FLAT_SQL = """actor, action, resource, error, severity, prediction, processing_time_ms,
  tags_removed"""


@query("d9_audit_events", f"""WITH {ACTIONS_SQL}
SELECT epoch_us(timestamp) AS at, {_FLAT_SQL} FROM logged""")
def built_events(spark, folder):
    return audit_events(spark, folder).select(*_flat())


@query("d10_event_ids", """SELECT count(*) AS events, count(*) AS distinct_ids, 16 AS digits
FROM events""")
def event_ids(spark, folder):
    events = audit_events(spark, folder)
    by_id = events.groupBy("event_id").agg(F.count("*").alias("n"))
    return by_id.agg(F.sum("n").alias("events"), F.count("*").alias("distinct_ids"),
                     F.max(F.length("event_id")).alias("digits"))


@query("d11_last_events", f"""WITH {ACTIONS_SQL}
SELECT epoch_us(timestamp) AS at, {_FLAT_SQL} FROM logged ORDER BY timestamp DESC LIMIT 100""")
def last_events(spark, folder):
    newest = audit.last_events(audit_events(spark, folder), 100)
    return newest.select(*_flat())


@query("d12_broken_seals", f"""WITH {ACTIONS_SQL}
SELECT epoch_us(timestamp) AS at, 'intruder' AS actor, resource FROM logged
WHERE processing_time_ms > 150""")
def broken_seals(spark, folder):
    sealed = written(audit.sealed(audit_events(spark, folder), SALT), "sealed-log")
    changed = sealed.withColumn("actor", F.when(
        F.col("metadata.processing_time_ms") > 150, "intruder").otherwise(F.col("actor")))
    return audit.broken_seals(changed, SALT).select(
        F.unix_micros("timestamp").alias("at"), "actor", "resource")


TAMPERED_SQL = ACTIONS_SQL + """,
before AS (SELECT id, timestamp AS ts, resource, date_trunc('day', timestamp) AS chunk FROM logged),
after AS (
  SELECT id, CASE WHEN id % 101 = 7 THEN ts + INTERVAL 26 HOUR ELSE ts END AS ts, resource
  FROM before WHERE id % 97 <> 5),
once AS (SELECT *, lag(resource) OVER (PARTITION BY chunk ORDER BY ts, resource) AS prev FROM before),
now AS (SELECT *, date_trunc('day', ts) AS chunk, lag(resource) OVER (
  PARTITION BY date_trunc('day', ts) ORDER BY ts, resource) AS prev FROM after)"""


def _tampered(spark, folder):
    """A linked log, its roots, and the log after events were deleted and moved to other days."""
    order, ident = ("timestamp", "resource"), "resource"
    log = audit_events(spark, folder)
    kept = written(audit.linked(log, SALT, order, ident, "day"), "linked-log")
    roots = written(audit.chunk_roots(kept, SALT), "log-roots")
    numbers = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.concat(F.substring(F.sha2(F.concat(
            F.lit("JohnDoe_"), F.col("event_id").cast("string")), 256), 1, 12), F.lit(".dcm"))
        .alias("resource"))
    later = F.when(F.col("id") % 101 == 7, F.col("timestamp") + F.expr("INTERVAL 26 HOURS"))
    changed = (kept.join(numbers, "resource").where(F.col("id") % 97 != 5)
               .withColumn("timestamp", F.coalesce(later, F.col("timestamp")))
               .drop("id").select(*kept.columns))
    return written(changed, "tampered-log"), roots, order, ident


@query("d12_broken_links", f"""WITH {TAMPERED_SQL}
SELECT epoch_us(n.ts) AS at, n.resource FROM now n JOIN once o USING (id)
WHERE n.ts <> o.ts OR n.prev IS DISTINCT FROM o.prev""")
def broken_links(spark, folder):
    """Deleted events show in their successors, moved ones in themselves and their neighbours."""
    changed, _, order, ident = _tampered(spark, folder)
    return audit.broken_links(changed, SALT, order, ident, "day").select(
        F.unix_micros("timestamp").alias("at"), "resource")


@query("d12_broken_chunks", f"""WITH {TAMPERED_SQL},
counts AS (SELECT chunk, sum(b)::BIGINT AS n, sum(a)::BIGINT AS found, sum(moved) AS moved FROM (
    SELECT chunk, 1 AS b, 0 AS a, 0 AS moved FROM before
    UNION ALL SELECT chunk, 0, 1, (id % 101 = 7)::INT FROM now
    UNION ALL SELECT chunk, 0, 0, (id % 101 = 7 OR id % 97 = 5)::INT FROM before) GROUP BY chunk)
SELECT epoch_us(chunk) AS day, n, found, CASE WHEN found < n THEN 'missing'
  WHEN found > n THEN 'added' ELSE 'changed' END AS fault FROM counts WHERE moved > 0""")
def broken_chunks(spark, folder):
    """Days whose events no longer give the root that was kept."""
    changed, roots, _, _ = _tampered(spark, folder)
    return audit.broken_chunks(changed, roots, SALT, "day").select(
        F.unix_micros(F.col("chunk").cast("timestamp")).alias("day"), "n", "found", "fault")


@query("d13_leaked_values", """SELECT c_custkey, c_name AS leaked FROM customer
WHERE c_custkey % 9 = 0""")
def leaked_values(spark, folder):
    customers = table(spark, folder, "customer")
    line = F.when(F.col("c_custkey") % 9 == 0, F.concat(
        F.lit('{"resource": "'), "c_name", F.lit('_MRI.dcm"}'))).otherwise(F.concat(
            F.lit('{"resource": "'), F.substring(F.sha2("c_name", 256), 1, 12), F.lit('"}')))
    log = customers.select("c_custkey", line.alias("line"))
    return audit.leaked_values(log, "line", customers, "c_name").select("c_custkey", "leaked")


@query("s3_pair_file", "WITH " + GROUPS_SQL + """
SELECT first1 AS path1, first2 AS path2, distance FROM near WHERE distance > 0
UNION ALL
SELECT g.first, p.id, 0 FROM prints p JOIN groups g USING (label, print) WHERE g.first < p.id""")
def pair_file(spark, folder):
    prints = fingerprints(spark, folder)
    groups, found = label_pairs(prints)
    rows = prints.join(groups, ["label", "print"])
    links = pairs.pair_links(found, rows, "id")
    path = scratch_path(spark, "pair-file")
    tables.write_pairs(links, path, "json")
    back = tables.read_pairs(spark, path, "json")
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("path1", "path2")})


@query("s6_audit_log", f"""WITH {ACTIONS_SQL}
SELECT epoch_us(timestamp) AS at, {_FLAT_SQL} FROM logged""")
def audit_log(spark, folder):
    """Appended in two parts with broken lines between them, and read back."""
    events, path = audit_events(spark, folder), scratch_path(spark, "audit-log")
    logs.append_events(events.where(F.col("severity").isNull()), path)
    logs.append_events(events.where(F.col("severity").isNotNull()), path)
    events.select(F.concat(F.lit("{broken "), "event_id").alias("value")).write.mode(
        "append").text(path)
    return logs.read_events(spark, path).select(*_flat())


@query("s7_bad_lines", "SELECT event_id FROM events WHERE event_id % 100 = 0")
def bad_lines(spark, folder):
    path = scratch_path(spark, "audit-lines")
    spoiled = F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("{broken "), "event_id"))
    table(spark, folder, "events").select(
        F.coalesce(spoiled, F.to_json(F.struct("event_id"))).alias("value")).write.text(path)
    return logs.bad_lines(spark, path).select(
        F.substring("value", 9, 20).cast("bigint").alias("event_id"))


@query("s8_metric_file", f"""WITH {CONFUSION_SQL}
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
  round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS f1_macro FROM per_class""")
def metric_file(spark, folder):
    figures = metrics.averages(metrics.per_class(
        metrics.confusion(predictions(spark, folder), TOPICS)))
    path = scratch_path(spark, "metric-file")
    tables.write_metrics(figures.withColumn("predictions", F.array(F.lit(1))), path)
    return rounded(spark.read.schema("accuracy double, f1_macro double").json(path),
                   "accuracy", "f1_macro")


@query("s11_access_log", r"""SELECT '10.0.0.' || user_id AS remote_addr, '-' AS remote_user,
  epoch_us(date_trunc('second', ts)) AS at, 'GET /' || event_type || ' HTTP/1.1' AS request,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_id AS bytes,
  round(value, 2) AS request_time FROM events""")
def access_log(spark, folder):
    ts = F.col("ts").cast("timestamp")
    line = F.format_string(
        '10.0.0.%d - - [%s] "GET /%s HTTP/1.1" %d %d "-" "probe/1.0" rt=%s',
        "user_id", F.date_format(ts, logs.ACCESS_TIME), "event_type",
        F.when(F.col("event_type") == "error", 500).otherwise(200), "event_id",
        F.format_string("%.2f", F.round("value", 2)))
    path = scratch_path(spark, "access-log")
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    return logs.read_access_log(spark, path).select(
        "remote_addr", "remote_user", F.unix_micros("ts").alias("at"), "request", "status",
        "bytes", "request_time")


@query("s11_rejected_lines", """SELECT CASE WHEN user_id IS NULL THEN NULL
  ELSE 'upstream timed out for 10.0.0.' || user_id END AS value FROM events
WHERE event_type = 'error'""")
def rejected_lines(spark, folder):
    """Lines of the error kind stand in another form between the access lines."""
    good = F.format_string('10.0.0.%d - - [01/Jan/2024:00:00:00 +0000] "GET /%s HTTP/1.1" 200 1 '
                           '"-" "probe/1.0" rt=0.1', "user_id", "event_type")
    bad = F.concat(F.lit("upstream timed out for 10.0.0."), "user_id")
    lines = table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", bad).otherwise(good).alias("value"))
    return logs.rejected_access_lines(lines)


@query("m1_api_responses", f"""WITH {predictions_sql()}
SELECT id, 'topic' || pred AS prediction, round(confidence, 4) AS confidence,
  substr(sha256('scan_' || id), 1, 12) || '.dcm' AS resource FROM pred""")
def api_responses(spark, folder):
    """Score, then log each prediction: the path of one upload as a table job."""
    scored = metrics.score_logits(predictions(spark, folder).select("id", "logits"), TOPIC_NAMES)
    logged = scored.select("id", audit.event(
        "predict", F.concat(F.lit("scan_"), "id", F.lit(".dcm")), "api",
        prediction=F.col("prediction"), confidence=F.round("confidence", 6)).alias("e"))
    return logged.select("id", F.col("e.result.prediction").alias("prediction"),
                         F.col("e.result.confidence").alias("confidence"),
                         F.col("e.resource").alias("resource"))
