"""Keyed state: rate limits and health checks as streams.

Rows wait in chunks, sorted and of bounded size, until a timer says that the watermark has passed the
earliest of them; all rows that it has passed are then replayed in the order of their time.  So
results do not depend on how rows fall into batches.  A key has one timer for its waiting rows, a
batch writes its own chunks and reads those that reach behind the watermark, and they are merged
row by row, so the calls to the state are few and no more than the chunks of one moment are in
memory.  Rows behind the watermark are dropped; see ``intake.reconciled`` for a feed that keeps
account of them.

Maps and timers need the RocksDB state store (``session.build_session`` and ``jobs.run_available``
set it).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush, heapreplace

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from cohort.operators.timelines import (BURSTS, PROBE_RETRIES, RATE_PER_SECOND,
                                        START_GRACE_SECONDS, admit)


#: Rows of one chunk, and distinct rows of a key that are sorted at once.
CHUNK_ROWS, SORTED_ROWS = 10_000, 200_000


class Replay(StatefulProcessor):
    """Feeds ``step`` with the rows of a key in the order of time.

    Rows are pairs (at, what) with ``unit`` values of ``at`` to the millisecond; equal rows are
    counted, not kept.  ``step`` takes the key's value (None at first) and the sorted rows
    (at, what, n), and returns the new value, the rows to give out, and the millisecond at which the
    value may be forgotten (None: never).  Rows of one time always come in one call.
    """

    def __init__(self, step: Callable, value: str, columns: list[str], unit: int = 1):
        self.step, self.value, self.columns, self.unit = step, value, columns, unit

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.value}, until bigint")
        self.index = handle.getValueState(
            "index", "following bigint, timer bigint, firsts array<bigint>, numbers array<bigint>")
        self.chunks = handle.getMapState(
            "chunks", "number bigint", "ats array<bigint>, whats array<bigint>, ns array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following, timer, waiting = self._waiting()
        fresh: Counter = Counter()
        for frame in rows:
            fresh.update(zip(frame["at"].tolist(), frame["what"].tolist()))
            if len(fresh) >= SORTED_ROWS:
                following = self._store(_sorted(fresh), following, waiting)
                fresh.clear()
        following = self._store(_sorted(fresh), following, waiting)
        self._wake(following, timer, waiting)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        mark = now * self.unit
        following, timer, waiting = self._waiting()
        held = self.held.get() if self.held.exists() else None
        value, until = (tuple(held[:-1]), held[-1]) if held else (None, None)
        due = sorted(w for w in waiting if w[0] < mark)
        rest: list[tuple] = []
        for rows in _portions(self._merged(due)):
            ready = rows[:bisect_left(rows, (mark,))]
            rest += rows[len(ready):]
            if len(rest) >= SORTED_ROWS:
                following = self._store(rest, following, waiting)
                rest = []
            if ready:
                value, out, until = self.step(value, ready)
                yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)
        for chunk in due:
            self.chunks.removeKey((chunk[1],))
            waiting.remove(chunk)
        following = self._store(rest, following, waiting)
        if due or (timer is not None and timer <= now):
            self._wake(following, None, waiting)
        if until is not None and until < now:
            self.held.clear()
        elif due and value is not None:
            self.held.update((*value, until))
            if until is not None:
                self.handle.registerTimer(until // 1000 * 1000 + 1001)
        yield pd.DataFrame(columns=self.columns)

    def _waiting(self) -> tuple[int, int | None, list[tuple[int, int]]]:
        """Number of the next chunk, the timer, and (earliest row, number) of each chunk."""
        if not self.index.exists():
            return 0, None, []
        following, timer, firsts, numbers = self.index.get()
        return following, timer, list(zip(firsts, numbers))

    def _store(self, rows: list[tuple], following: int, waiting: list) -> int:
        """Add sorted rows as chunks."""
        for start in range(0, len(rows), CHUNK_ROWS):
            part = rows[start:start + CHUNK_ROWS]
            self.chunks.updateValue((following,), tuple(list(c) for c in zip(*part)))
            waiting.append((part[0][0], following))
            following += 1
        return following

    def _wake(self, following: int, timer: int | None, waiting: list) -> None:
        """Keep the index, and be called when the watermark has passed the earliest row."""
        if not waiting:
            self.index.clear()
            return
        wanted = min(waiting)[0] // self.unit + 1
        if timer is None or wanted < timer:
            self.handle.registerTimer(wanted)
            timer = wanted
        firsts, numbers = (list(c) for c in zip(*waiting))
        self.index.update((following, timer, firsts, numbers))

    def _merged(self, due: list[tuple[int, int]]) -> Iterator[tuple]:
        """Rows of chunks in order; a chunk is read when the merge has come to its first row."""
        heap: list[tuple] = []
        for place in range(len(due) + 1):
            bound = due[place][0] if place < len(due) else None
            while heap and (bound is None or heap[0][0] < bound):
                *row, number, others = heap[0]
                yield tuple(row)
                after = next(others, None)
                if after is None:
                    heappop(heap)
                else:
                    heapreplace(heap, (*after, number, others))
            if place < len(due):
                others = zip(*self.chunks.getValue((due[place][1],)))
                heappush(heap, (*next(others), due[place][1], others))


def _sorted(counts: Counter) -> list[tuple]:
    return sorted((at, what, n) for (at, what), n in counts.items())


def _portions(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Sorted rows with equal ones added up, in lists that do not part rows of one time."""
    portion: list[tuple] = []
    for at, what, n in rows:
        if portion and portion[-1][:2] == (at, what):
            portion[-1] = (at, what, portion[-1][2] + n)
            continue
        if len(portion) >= CHUNK_ROWS and portion[-1][0] != at:
            yield portion
            portion = []
        portion.append((at, what, n))
    if portion:
        yield portion


def streamed_breaches(requests: DataFrame, rate: float = RATE_PER_SECOND,
                      burst: int = BURSTS["/predict"], client: str = "client",
                      delay: str = "10 seconds") -> DataFrame:
    """Refused requests per client and millisecond.

    The state is the level of the bucket and the waiting requests, counted per millisecond; the
    level is forgotten when the bucket must have drained.
    """
    kind = requests.schema[client].dataType.simpleString()
    drained_ms = int((burst + 1) / rate * 1000) + 1

    def step(bucket, rows):
        out = []
        for at, _, n in rows:
            bucket, passed = admit(bucket, int(at), int(n), rate, burst)
            if passed < n:
                out.append((int(at), int(n), int(n) - passed))
        return (float(bucket[0]), int(bucket[1])), out, int(bucket[1]) + drained_ms

    timed = (requests.withWatermark("ts", delay)
             .select(client, "ts", F.unix_millis("ts").alias("at"),
                     F.lit(0).cast("bigint").alias("what")))
    return timed.groupBy(client).transformWithStateInPandas(
        Replay(step, "level double, last bigint", [client, "at", "n", "refused"]),
        f"{client} {kind}, at bigint, n bigint, refused bigint", "append", "eventTime"
    ).withColumn("at", F.timestamp_millis("at"))


def health_changes(probes: DataFrame, retries: int = PROBE_RETRIES,
                   grace_seconds: int = START_GRACE_SECONDS, delay: str = "1 minute"
                   ) -> DataFrame:
    """A row whenever a target turns unhealthy or recovers: target, at, healthy.

    Of probes at one time the failed ones count first.  A target is remembered as long as the
    stream runs; there are few.
    """
    kind = probes.schema["target"].dataType.simpleString()

    def step(value, rows):
        begin, failures = value or (int(rows[0][0]), 0)
        out = []
        for at, ok, n in rows:
            if ok:
                if failures >= retries:
                    out.append((int(at), True))
                failures = 0
            elif at - begin >= grace_seconds * 1_000_000:
                if failures < retries <= failures + n:
                    out.append((int(at), False))
                failures += int(n)
        return (begin, failures), out, None

    timed = probes.withWatermark("ts", delay).select(
        "target", "ts", F.unix_micros("ts").alias("at"),
        F.coalesce(F.col("ok").cast("bigint"), F.lit(0)).alias("what"))
    return timed.groupBy("target").transformWithStateInPandas(
        Replay(step, "begin bigint, failures bigint", ["target", "at", "healthy"], 1000),
        f"target {kind}, at bigint, healthy boolean", "append", "eventTime"
    ).withColumn("at", F.timestamp_micros("at"))
