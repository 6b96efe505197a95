import datetime
import os
import random
import shutil
import time
import urllib.parse

import pytest
from conftest import picture, png
from pyspark.sql import functions as F

from cohort.operators import pairs, timelines
from cohort.operators.fingerprint import image_prints
from cohort.sources import images, logs
from cohort.streaming import arrivals, feeds, intake, stateful
from cohort.streaming.jobs import run_available


def stream(spark, frame, tmp_path, name="source"):
    path = str(tmp_path / name)
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


END = datetime.datetime(2024, 2, 1)


def dealt_stream(spark, frame, tmp_path, files):
    """The rows in any order over some files, one file a batch, and the end behind them."""
    path = tmp_path / f"dealt-{files}"
    for k in range(files):
        frame.where(F.pmod(F.hash(*frame.columns), F.lit(files)) == k).orderBy(
            F.rand(files)).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)  # files are read in the order of their times
    end = [F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name)
           for f in frame.schema]
    spark.range(1).select(*end).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def at(seconds):
    return F.timestamp_millis((F.lit(1_704_067_200_000) + seconds * 1000).cast("bigint"))


def request_times(rng):
    """One client floods, one keeps the limit, one comes and goes."""
    flood = [("flood", i / 35) for i in range(200)]
    calm = [("calm", i / 9) for i in range(100)]
    bursts = [("bursts", 100 * b + rng.random() * 0.5) for b in range(4) for _ in range(40)]
    return flood + calm + bursts


def naive_refused(times, rate, burst):
    """Request by request, as the proxy counts them."""
    state, refused = None, {}
    for ms in sorted(round(t * 1000 - 0.5) for t in times):
        level = 0.0 if state is None else max(
            0.0, state[0] - rate * (ms - state[1]) / 1000.0 + 1.0)
        if level > burst:
            refused[ms] = refused.get(ms, 0) + 1
        else:
            state = (level, ms)
    return refused


def test_leaky_bucket_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = request_times(rng)
    millis = [(c, int(t * 1000)) for c, t in rows]
    frame = spark.createDataFrame(millis, "client string, ms bigint").select(
        "client", F.timestamp_millis(F.col("ms") + 1_704_067_200_000).alias("ts"))
    batch = timelines.rate_breaches(frame, 10.0, 20)
    got = {}
    for r in batch.select("client", F.unix_millis("at").alias("at"), "refused").collect():
        got.setdefault(r.client, {})[r.at - 1_704_067_200_000] = r.refused
    expected = {}
    for client in ("flood", "calm", "bursts"):
        times = [(ms + 0.5) / 1000 for c, ms in millis if c == client]
        refused = naive_refused(times, 10.0, 20)
        if refused:
            expected[client] = refused
    assert got == expected and set(got) == {"flood", "bursts"}
    for files in (1, 3):
        live = run_available(stateful.streamed_breaches(
            dealt_stream(spark, frame, tmp_path, files), 10.0, 20, delay="2 hours"), "breaches")
        assert sorted(live.collect()) == sorted(batch.collect())
    busy = timelines.busy_seconds(frame)
    assert {r.client for r in busy.collect()} == {"flood", "bursts"}


def probe_frame(spark):
    oks = [True, False, False, True, False, False, False, False, True, False, False, False]
    rows = [("a", 60 + 30 * i, ok) for i, ok in enumerate(oks)]
    rows += [("late", 30 * i, i >= 5) for i in range(8)]
    return spark.createDataFrame(rows, "target string, s int, ok boolean").select(
        "target", at(F.col("s")).alias("ts"), "ok")


def test_health_batch_and_stream(spark, tmp_path):
    probes = probe_frame(spark)
    spans = timelines.unhealthy_spans(probes).select(
        "target", F.unix_millis("unhealthy_from").alias("u"), "failures").collect()
    base = 1_704_067_200_000
    assert sorted((r.target, (r.u - base) // 1000, r.failures) for r in spans) == [
        ("a", 60 + 30 * 6, 4), ("a", 60 + 30 * 11, 3), ("late", 120, 3)]
    for files in (1, 3):
        live = run_available(stateful.health_changes(
            dealt_stream(spark, probes, tmp_path, files), delay="2 hours"), "health")
        rows = sorted((r.target, (r.u - base) // 1000, r.healthy) for r in live.select(
            "target", F.unix_millis("at").alias("u"), "healthy").collect())
        assert rows == [("a", 240, False), ("a", 300, True), ("a", 390, False),
                        ("late", 120, False), ("late", 150, True)]


def test_time_never_runs_back_in_a_bucket():
    state, passed = timelines.admit((5.0, 10_000), 9_000, 1, 10.0, 20)
    assert passed == 1 and state == (6.0, 10_000)


def test_sessions_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), rng.random() * 200_000) for _ in range(300)] + [("end", 400_000.0)]
    events = spark.createDataFrame(rows, "actor string, s double").select(
        "actor", at(F.col("s")).alias("ts"))
    batch = timelines.sessions(events)
    expected = []
    for actor in "xyz":
        times = sorted(int(s * 1000) for a, s in rows if a == actor)
        start, count = times[0], 0
        for i, t in enumerate(times):
            count += 1
            if i + 1 == len(times) or times[i + 1] - t >= 1_800_000:
                expected.append((actor, start, t, count))
                start, count = (times[i + 1] if i + 1 < len(times) else None), 0
    got = [(r.actor, r.a - 1_704_067_200_000, r.b - 1_704_067_200_000, r.events)
           for r in batch.select("actor", F.unix_millis("session_start").alias("a"),
                                 F.unix_millis("last_event").alias("b"), "events").collect()
           if r.actor != "end"]
    assert sorted(got) == sorted(expected)
    live = run_available(feeds.streamed_sessions(stream(spark, events, tmp_path)), "sessions")
    assert sorted(live.collect()) == sorted(batch.where("actor <> 'end'").collect())


def test_monitor_emits_closed_windows_only(spark, tmp_path):
    rows = spark.range(100).select(
        at(F.col("id")).alias("ts"), (F.col("id") % 2).cast("string").alias("class"),
        F.lit(0.5).alias("confidence"), F.col("id").cast("double").alias("latency_ms"))
    closed = run_available(feeds.monitored(stream(spark, rows, tmp_path), delay="10 seconds"),
                           "monitor")
    table = timelines.monitor(rows)
    shown = set(closed.collect())
    assert shown <= set(table.collect()) and 0 < len(shown) < table.count()
    assert all(r.p95 >= r.p50 for r in shown)


def test_late_rows_are_dropped_and_repeats_written_once(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "event_id string, timestamp timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "event_id string, s bigint").select(
            "event_id", at(F.col("s")).alias("timestamp")).coalesce(1).write.mode("append").parquet(
            source)

    def run():
        feeds.audit_sink(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"),
                         str(tmp_path / "progress"), "10 minutes").awaitTermination()

    arrive([("a", 0), ("a", 5), ("b", 7200)])
    run()
    arrive([("b", 7201), ("late", 10), ("c", 7300)])
    run()
    found = [r.event_id for r in logs.read_events(spark, str(tmp_path / "out")).collect()]
    assert sorted(found) == ["a", "b", "c"]


@pytest.mark.parametrize("bucket_rows", [2000, 0])
def test_arriving_images_meet_known_ones(spark, image_folder, tmp_path, bucket_rows):
    known_prints = image_prints(images.decode_images(spark, f"{image_folder}/Training")).where(
        F.col("print").isNotNull())
    known, refined = arrivals.known_bands(pairs.print_groups(known_prints, "path"),
                                          bucket_rows=bucket_rows)
    assert refined == (bucket_rows == 0)
    incoming = str(tmp_path / "incoming")
    shutil.copytree(f"{image_folder}/Testing", incoming)
    decoded = images.decode_images(spark, incoming).select("path", "image")
    arriving = image_prints(stream(spark, decoded, tmp_path))
    found = run_available(arrivals.arriving_duplicates(
        arriving.select("path", "print"), "path", known, refined), "arrivals").collect()
    names = {(os.path.basename(r.path), os.path.basename(r.known_first)) for r in found}
    assert ("copy.png", "glioma_Tr_0.png") in names
    assert {b for _, b in names} == {"glioma_Tr_0.png"} and len(found) == len(names)


@pytest.fixture
def known_images(spark, image_folder):
    prints = image_prints(images.decode_images(spark, f"{image_folder}/Training")).where(
        F.col("print").isNotNull())
    return arrivals.known_bands(pairs.print_groups(prints, "path"))


def test_uploads_are_decoded_checked_and_looked_up(spark, image_folder, tmp_path, known_images):
    folder = tmp_path / "uploads"
    folder.mkdir()
    for i in (1, 2):
        (folder / f"fine [{i}] {{x}}.png").write_bytes(png(picture(100 + i)))
    shutil.copy(f"{image_folder}/Training/glioma/glioma_Tr_0.png", folder / "again.png")
    (folder / "junk.png").write_bytes(b"not a picture")
    (folder / "cut.png").write_bytes(png(picture(3))[:90])
    (folder / "notes.txt").write_bytes(b"x")
    out = str(tmp_path / "out")

    def run(progress):
        intake.intake(intake.arriving_files(spark, str(folder), 3), "path", intake.checked_images,
                      *known_images, out, str(tmp_path / progress)).awaitTermination()

    def name(path):
        return urllib.parse.unquote(os.path.basename(path))

    run("progress")
    shown = []
    for _ in range(2):
        good = sorted(name(r.path) for r in intake.accepted(spark, out).collect())
        bad = sorted((name(r.path), r.reason) for r in intake.rejected(spark, out).collect())
        met = [(name(r.path), os.path.basename(r.known_first), r.distance)
               for r in intake.matches(spark, out).collect()]
        shown.append((good, bad, met))
        # all batches once more, as after a crash: nothing is written twice
        run("progress-again")
    assert shown[0] == shown[1] == (
        ["again.png", "fine [1] {x}.png", "fine [2] {x}.png"],
        [("cut.png", "could not open image"), ("junk.png", "could not open image"),
         ("notes.txt", "unsupported file type")],
        [("again.png", "glioma_Tr_0.png", 0)])
    assert {r.batch for r in intake.rejected(spark, out).select("batch").collect()} <= {0, 1, 2}


def plain_outcomes(batches, delay):
    times, out, latest = {}, [], None
    for batch in batches:
        mark = None if latest is None else latest - delay
        # keys kept by earlier batches count as long as their rows are not behind the mark
        kept = {k for k, ts in times.items() if mark is None or max(ts) >= mark}
        for key, s in sorted(batch, key=lambda r: (r[1] is None, r[1] or 0)):
            if s is None or (mark is not None and s < mark):
                out.append((key, s, "late"))
            elif key is not None and key in kept:
                out.append((key, s, "repeated"))
            else:
                kept.add(key)
                times.setdefault(key, []).append(s)
                out.append((key, s, "kept"))
            if out[-1][2] != "late":
                latest = s if latest is None else max(latest, s)
    return sorted(out, key=str)


def test_late_and_repeated_events_add_up(spark, tmp_path):
    rng = random.Random(9)
    batches = [[(rng.choice([None, *"abcdefghijklmnop"]) if rng.random() < 0.9 else f"k{rng.random()}",
                 rng.choice([None, 600 * b + rng.randrange(1200)])) for _ in range(40)]
               for b in range(5)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id string, s bigint").select(
            "event_id", "s", F.when(F.col("s").isNotNull(), at(F.col("s"))).alias("timestamp")
        ).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    schema = "event_id string, s bigint, timestamp timestamp"

    def run(progress):
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        intake.reconciled(events, out, str(tmp_path / progress), 300_000).awaitTermination()

    run("progress")
    for _ in range(2):
        rows = intake.outcomes(spark, out).collect()
        want = plain_outcomes(batches, 300)
        # of one key and time any row may be the one kept
        assert sorted(((r.event_id, r.s, r.outcome) for r in rows), key=str) == want
        report = intake.batch_report(spark, out).collect()
        assert [r.kept + r.late + r.repeated for r in sorted(report)] == [40] * 5
        assert {o for _, _, o in want} == {"kept", "late", "repeated"}
        run("progress-again")
