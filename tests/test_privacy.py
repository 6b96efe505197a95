import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from cohort.functions.keyed import hmac_sha256
from cohort.functions.names import sanitized, stem, suffix
from cohort.operators import audit, privacy, validate
from cohort.sources import logs, tables


@pytest.mark.parametrize("key", ["test-salt", "k" * 64, "long" * 40])
def test_hmac_equals_the_library(spark, key):
    values = ["1.2.3.4.5", "", "Ünïcode", "x" * 200]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    found = {r.v: r.h for r in frame.select("v", hmac_sha256(key, F.col("v")).alias("h"))
             .collect()}
    assert found == {v: hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest()
                     for v in values}


def test_pseudonyms(spark):
    row = spark.createDataFrame([("1.2.3.4.5",)], "v string").select(
        privacy.keyed_uid(F.col("v"), "salt-A").alias("a"),
        privacy.keyed_uid(F.col("v"), "salt-A").alias("again"),
        privacy.keyed_uid(F.col("v"), "salt-B").alias("b"),
        privacy.keyed_uid(F.col("v"), "salt-A", "decimal").alias("d")).first()
    assert row.a == row.again != row.b and row.a.startswith("2.25.") and len(row.a) == 65
    assert row.d[5:].isdigit() and len(row.d) <= 64
    with pytest.raises(ValueError):
        privacy.keyed_uid(F.lit("x"), "")


def test_header_table(spark):
    rows = spark.createDataFrame([
        ("a.dcm", {"PatientName": "Doe^John", "StudyInstanceUID": "1.2.840.1", "Modality": "MR"}),
        ("b.dcm", None)], "path string, tags map<string,string>")
    done = {r.path: r for r in privacy.deidentify_tags(rows, "s").collect()}
    a = done["a.dcm"]
    assert a.tags["PatientName"] == "" and a.tags["Modality"] == "MR"
    assert a.tags["StudyInstanceUID"].startswith("2.25.") and "PatientID" not in a.tags
    assert [tuple(x) for x in a.removed] == [("PatientName", 8)]
    assert a.hashed[0].original_prefix == "1.2.840." + "..."
    assert done["b.dcm"].error and a.error is None
    assert len(privacy.REMOVE_TAGS) == 25 and len(privacy.HASH_TAGS) == 5


@pytest.mark.parametrize("per_row_salt", [False, True])
def test_encryption_round_trip(spark, per_row_salt, monkeypatch):
    rows = spark.createDataFrame([(i, f"secret {i}" * i) for i in range(5)], "id int, v string")
    blobs = privacy.encrypt(rows, "v", "pw", per_row_salt)
    stored = blobs.collect()
    assert all(len(r.v) == 16 + 12 + len(f"secret {r.id}" * r.id) + 16 for r in stored)
    assert len({bytes(r.v[:16]) for r in stored}) == (5 if per_row_salt else 1)
    assert len({bytes(r.v[16:28]) for r in stored}) == 5
    fixed = spark.createDataFrame(stored, blobs.schema)
    back = privacy.decrypt(fixed, "v", "pw").collect()
    assert {r.id: bytes(r.v).decode() for r in back} == {i: f"secret {i}" * i for i in range(5)}
    wrong = privacy.decrypt(fixed, "v", "other", strict=False)
    assert wrong.where(F.col("v").isNotNull()).isEmpty()
    with pytest.raises(Exception):
        privacy.decrypt(fixed, "v", "other").collect()
    flipped = [(r.id, bytearray(r.v[:-1] + bytes([r.v[-1] ^ 1]))) for r in stored]
    tampered = spark.createDataFrame(flipped, "id int, v binary")
    assert privacy.decrypt(tampered, "v", "pw", strict=False).where("v is not null").isEmpty()


def test_names(spark):
    names = ["dir/JohnDoe_MRI.dcm", "a.tar.gz", "noext", ".hidden", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", stem(F.col("n")).alias("stem"), suffix(F.col("n")).alias("suffix"),
        sanitized(F.col("n")).alias("s")).collect()
    found = {r.n: (r.stem, r.suffix) for r in rows}
    assert found["dir/JohnDoe_MRI.dcm"] == ("JohnDoe_MRI", ".dcm")
    assert found["a.tar.gz"] == ("a.tar", ".gz") and found["noext"] == ("noext", "")
    assert found[".hidden"] == (".hidden", "")
    safe = {r.n: r.s for r in rows}
    assert safe[""] == safe[None] == "unknown"
    assert safe["dir/JohnDoe_MRI.dcm"] == hashlib.sha256(b"JohnDoe_MRI").hexdigest()[:12] + ".dcm"


def test_upload_checks(spark):
    rows = spark.createDataFrame([
        ("ok.jpg", "image/jpeg", 10, True), ("ok.PNG", None, 10, True),
        ("test.bmp", "image/bmp", 10, True), ("x.jpg", "application/pdf", 10, True),
        ("big.png", "image/png", 11 * 1024 * 1024, True), ("bad.png", "", 10, False),
        (None, "image/png", 10, True)],
        "name string, type string, size bigint, ok boolean")
    reason = validate.reject_reason(F.col("name"), F.col("type"), F.col("size"), F.col("ok"))
    checked = rows.withColumn("reason", reason)
    assert [r.reason for r in checked.collect()] == [
        None, None, "unsupported file type", "invalid content type", "file too large",
        "could not open image", "unsupported file type"]
    assert validate.accepted(checked).count() == 2 and validate.dead_letters(checked).count() == 5
    assert {r.outcome: r.n for r in validate.reject_counts(checked).collect()}["accepted"] == 2


def events(spark, n=5):
    rows = spark.range(n).select("id", F.concat(F.lit("scan_"), "id", F.lit(".dcm")).alias("f"))
    built = audit.event("predict", F.col("f"), "api", prediction=F.lit("glioma"),
                        confidence=F.lit(0.94321), processing_time_ms=F.lit(45.2))
    at = F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)
    return audit.stamped(rows.select(at.alias("at"), built.alias("event")), at=F.col("at"))


def test_audit_log_is_appended_and_bad_lines_are_skipped(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_events(events(spark), path)
    logs.append_events(events(spark, 2), path)
    (tmp_path / "log" / "part-broken.json").write_text("{oops\n")
    assert logs.read_events(spark, path).count() == 7
    assert [r.value for r in logs.bad_lines(spark, path).collect()] == ["{oops"]
    newest = audit.last_events(logs.read_events(spark, path), 3).collect()
    assert len(newest) == 3 and newest[0].timestamp >= newest[-1].timestamp
    first = newest[0]
    assert first.result.confidence == 0.9432 and first.metadata.processing_time_ms == 45.2
    line = json.loads(next(iter(spark.read.text(path).where("value like '%predict%'")
                                .collect())).value)
    assert "scan_" not in json.dumps(line) and len(line["event_id"]) == 16
    assert events(spark).select("event_id").distinct().count() == 5
    assert sorted(events(spark).collect()) == sorted(events(spark).collect())


def test_seals_and_leaks(spark):
    sealed = audit.sealed(events(spark), "key")
    assert audit.broken_seals(sealed, "key").isEmpty()
    assert audit.broken_seals(sealed, "other").count() == 5
    changed = sealed.withColumn("actor", F.lit("someone"))
    assert audit.broken_seals(changed, "key").count() == 5
    log = spark.createDataFrame([("file JohnDoe_MRI",), ("nothing",), ("J",), ("",)],
                                "line string")
    names = spark.createDataFrame([("JohnDoe",), ("Jane",), ("J",), (None,), ("",)],
                                  "name string")
    found = {(r.line, r.leaked) for r in audit.leaked_values(log, "line", names, "name").collect()}
    assert found == {("file JohnDoe_MRI", "JohnDoe"), ("file JohnDoe_MRI", "J"), ("J", "J")}


def test_pair_files(spark, tmp_path):
    assert tables.read_pairs(spark, str(tmp_path / "none")).count() == 0
    pairs = spark.createDataFrame([("a", "b", 3)], tables.PAIR_SCHEMA)
    for kind in ("parquet", "json"):
        tables.write_pairs(pairs, str(tmp_path / kind), kind)
        assert tables.read_pairs(spark, str(tmp_path / kind), kind).collect() == pairs.collect()


def test_training_history_file(spark, tmp_path):
    for run, n in (("one", 3), ("two", 2)):
        (tmp_path / run).mkdir()
        columns = {c: [i + 0.5 for i in range(n)] for c in tables.HISTORY_COLUMNS}
        (tmp_path / run / "training_history.json").write_text(json.dumps(columns, indent=2))
    rows = tables.read_history(spark, str(tmp_path)).collect()
    assert sorted((r.run, r.epoch, r.lr) for r in rows) == [
        ("one", 1, 0.5), ("one", 2, 1.5), ("one", 3, 2.5), ("two", 1, 0.5), ("two", 2, 1.5)]


def test_metric_files_leave_raw_arrays_out(spark, tmp_path):
    document = spark.createDataFrame([(0.5, [1], [[0.1]])],
                                     "accuracy double, labels array<int>, "
                                     "probabilities array<array<double>>")
    tables.write_metrics(document, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).columns == ["accuracy"]


def test_access_log(spark, tmp_path):
    (tmp_path / "access.log").write_text(
        '10.0.0.1 - - [02/Jan/2024:03:04:05 +0100] "GET /predict HTTP/1.1" 200 12 "-" "curl/8" '
        'rt=0.120\nrubbish\n')
    row, = logs.read_access_log(spark, str(tmp_path)).collect()
    assert (row.remote_addr, row.status, row.bytes, row.request_time) == ("10.0.0.1", 200, 12, 0.12)
    assert row.ts.isoformat() == "2024-01-02T02:04:05" or row.ts.hour == 2
