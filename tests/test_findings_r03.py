"""Findings of the third round on streams, rate limits, leaked values, cosine pairs and prints."""

import datetime
import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort.operators import audit, cosine, fingerprint, timelines
from cohort.plans import catalogue, stream_queries
from cohort.session import written
from cohort.streaming import feeds, stateful
from cohort.streaming.jobs import run_available, with_end

END = datetime.datetime(2024, 2, 1)


@pytest.fixture
def foldered(spark, small, tmp_path):
    """The smallest documents as a folder of files, as larger tables come."""
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_a_table_streams_as_a_file_and_as_a_folder(spark, small, foldered):
    whole = spark.read.parquet(f"{small}/documents.parquet").count()
    for folder in (small, foldered):
        stream = stream_queries.stream_of(spark, folder, "documents").select("doc_id")
        assert run_available(stream, "whole").count() == whole


@pytest.mark.parametrize("name", ["st1_arrivals", "st1_dead_letters", "st1_intake"])
def test_documents_in_a_folder_arrive(spark, foldered, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{foldered}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT count(*) FROM ({catalogue.ORACLE[name]})").fetchone()[0]
    assert catalogue.QUERIES[name](spark, foldered).count() == want > 0


def test_breaches_of_long_periods_equal_a_plain_replay(spark):
    """Three clients whose single busy periods are long; the size of their table is not known."""
    millis = [(c, 7000 * i + 13 * c) for c in range(3) for i in range(3000)]
    frame = spark.createDataFrame(millis, "client int, ms bigint").repartition(4).select(
        "client", F.timestamp_millis(F.col("ms") + 1_704_067_200_000).alias("ts"))
    want = set()
    for c in range(3):
        state = None
        for client, ms in millis:
            if client == c:
                state, passed = timelines.admit(state, ms, 1, 0.1, 2)
                if not passed:
                    want.add((c, ms, 1, 1))
    even = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(even, "false")  # small shuffles would end in one task
        found = timelines.rate_breaches(frame, 0.1, 2)
        got = {(r.client, r.ms, r.n, r.refused) for r in found.withColumn(
            "ms", F.unix_millis("at") - 1_704_067_200_000).collect()}
    finally:
        spark.conf.unset(even)
    assert got == want and want


def test_leaked_values_do_not_pass_through_the_driver(spark):
    texts = ["aXbXc", "Xb", "über über", "", None, "aXbXc", "abcdefgh" * 5, "x"]
    values = ["X", "Xb", "über", "abcdefghabc", "habcdefgha", "zz", "", None, "aXbXc"]
    log = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    names = spark.createDataFrame([(v,) for v in values + values], "name string")
    found = audit.leaked_values(log, "line", names, "name")
    want = sorted((i, t, v) for i, t in enumerate(texts) for v in values if t and v and v in t)
    assert found.columns == ["id", "line", "leaked"]
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_latencies(spark, tmp_path):
    """60,000 different latencies of one class in one window, and their exact quantiles."""
    rows = spark.range(60_000).select(
        F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") % 1000).alias("ts"),
        F.lit("a").alias("class"), F.lit(0.5).alias("confidence"),
        (F.pmod(F.col("id") * 7919, F.lit(60_000)) + 1).cast("double").alias("latency_ms"))
    return rows, (60_000, 30_000.0, 57_000.0)


def test_monitored_quantiles_are_exact(spark, many_latencies, tmp_path):
    rows, want = many_latencies
    for found in (timelines.monitor(rows), run_available(feeds.monitored(
            with_end(_stream(spark, rows, tmp_path), END)), "monitor")):
        assert [(r.n, r.p50, r.p95) for r in found.collect()] == [want]


def _stream(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("sizes", [(10_000, 200_000), (7, 20)])
def test_waiting_rows_take_few_calls_to_the_state(monkeypatch, sizes):
    """Rows in any order, in several batches, are replayed in order, and no call is made per row."""
    monkeypatch.setattr(stateful, "CHUNK_ROWS", sizes[0])
    monkeypatch.setattr(stateful, "SORTED_ROWS", sizes[1])
    handle = Handle()
    replay = stateful.Replay(lambda value, rows: ((len(rows),), list(rows), None), "v bigint",
                             ["key", "at", "what", "n"])
    replay.init(handle)
    rng, rows, out, mark = random.Random(3), [], [], 0
    for batch in range(4):
        fresh = [(rng.randrange(mark, mark + 900_000), rng.randrange(2)) for _ in range(300)]
        fresh += fresh[:20]
        rows += fresh
        list(replay.handleInputRows(("k",), iter([pd.DataFrame(fresh, columns=["at", "what"])]),
                                    None))
        mark = 400_000 * (batch + 1) if batch < 3 else 10_000_000
        while (due := [t for t in handle.timers if t <= mark]):
            handle.timers.remove(due[0])
            for frame in replay.handleExpiredTimer(("k",), Mark(mark), None):
                out += frame.itertuples(index=False, name=None)
    assert out == [("k", *r, n) for r, n in sorted(Counter(rows).items())]
    assert not handle.states["chunks"].rows and not handle.timers
    if sizes[0] > len(rows):
        assert handle.calls < 100


class Mark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


class Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, [], {}

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State(self))

    def getMapState(self, name, key_schema, value_schema):
        return self.getValueState(name, value_schema)


class State:
    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def _call(self):
        self.handle.calls += 1

    def exists(self):
        self._call()
        return None in self.rows

    def containsKey(self, key):
        self._call()
        return key in self.rows

    def get(self):
        self._call()
        return self.rows[None]

    def getValue(self, key):
        self._call()
        return self.rows[key]

    def update(self, value):
        self._call()
        self.rows[None] = value

    def updateValue(self, key, value):
        self._call()
        self.rows[key] = value

    def removeKey(self, key):
        self._call()
        del self.rows[key]

    def clear(self):
        self._call()
        self.rows.clear()


def shuffled_bytes(spark) -> dict[int, int]:
    """Bytes that each stage still known has written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    store = context.statusStore()
    defaults = [getattr(store, f"stageList$default${i}")() for i in range(2, 6)]
    stages = store.stageList(None, *defaults)
    found = [stages.apply(i) for i in range(stages.size())]
    return {stage.stageId(): stage.shuffleWriteBytes() for stage in found}


@pytest.mark.parametrize("name", ["bigint", "string"])
def test_vectors_move_once_for_a_strip_and_not_for_every_block(spark, name):
    """Random vectors, where no bound prunes: about 100 small blocks, each of which meets all."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 32))
    frame = spark.createDataFrame([(i + 10**17, v.tolist()) for i, v in enumerate(vectors)],
                                  "id bigint, v array<double>").withColumn("id", F.col("id").cast(name))
    groups = written(cosine.vector_groups(frame, "id", "v"), "vectors")
    last = max(shuffled_bytes(spark))
    found = cosine.cosine_pairs(groups, 0.1, block_rows=8).collect()
    moved = sum(size for stage, size in shuffled_bytes(spark).items() if stage > last)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.1, 1))
    assert {(int(r.first1) - 10**17, int(r.first2) - 10**17) for r in found} == set(
        zip(i.tolist(), j.tolist()))
    assert len(found) == len(i) > 1000
    assert 0 < moved < 15 * vectors.nbytes


def test_prints_of_texts_of_many_tokens_equal_a_plain_count(spark):
    """Around 255 tokens, which is what one byte can count, and far beyond."""
    sizes = [0, 1, 2, 254, 255, 256, 509, 510, 511, 20_000]
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(20_000)]
    texts = [(k, " ".join(names[:size]) + " 12 ") for k, size in enumerate(sizes)]
    frame = spark.createDataFrame([*texts, (99, None)], "id int, text string").coalesce(1)
    found = {r.id: r.print for r in frame.select(
        "id", fingerprint.text_print(F.col("text")).alias("print")).collect()}
    for k, size in enumerate(sizes):
        hashes = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in names[:size]]
        counts = [sum(h >> b & 1 for h in hashes) for b in reversed(range(64))]
        middle = sum(sorted(counts)[31:33]) / 2
        want = "".join("1" if c > middle else "0" for c in counts)
        assert found[k] == (f"{int(want, 2):016x}" if size else None)
    assert found[99] is None


def test_bits_are_added_as_bytes_without_overflow():
    sizes = np.array([255, 1, 256, 1000])
    hashes = np.random.default_rng(2).integers(0, 256, (sizes.sum(), 8)).astype(np.uint8)
    hashes[:512] = 255
    bits, ends = np.unpackbits(hashes, axis=1).astype(int), np.cumsum(sizes)
    want = [bits[e - n:e].sum(axis=0) for n, e in zip(sizes, ends)]
    assert np.array_equal(fingerprint._bit_counts(hashes, sizes), want)
