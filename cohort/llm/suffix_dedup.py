"""Removal of repeated passages by a suffix array over content-defined places.

A passage of ``least`` bytes is repeated if it also starts earlier.  Sorting the suffixes of all
places would move each byte ``least`` times, so suffixes are grouped by anchors.  Among the
starts of the ``gram``-byte strings inside a passage, the anchor is the one with the lowest hash:
equal passages have equal anchors, and neighbouring passages mostly share one.

1. Anchors whose gram occurs once cannot lie in a repeat.  Gram hashes are sorted by sampled
   ranges, those without an equal neighbour go, anchors of copies of one text counting once; the
   edges of a range stay, as the neighbour may lie in the next one.
2. The other anchors give suffixes: the bytes of all passages that share the anchor.  Sampled
   splitters deal them into as many ranges as there are shuffle partitions, by the leading bytes
   from the anchor on, then by document, so a frequent suffix spreads over ranges.  A range is
   read in that order, a run of bounded size at a time, and a run sorts its passages by multikey
   quicksort, eight bytes at a time, only ties going on.  All but the earliest of equal passages are repeats.
3. Passages with the first or last leading bytes of a run may have equals beyond it.  Their
   earliest occurrences, one per run, are compared across runs by digest.

Exact copies of whole texts are found first; only the earliest takes part in steps 2 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohort.llm.textbytes import BASE, chunks, mix
from cohort.session import release, written

LEAST, GRAM, LEAD = 100, 32, 16
#: Suffixes, and their bytes, that are sorted in memory at once; bytes that a step gives out.
RANGE, RANGE_BYTES, OUTPUT = 40_000, 1 << 23, 1 << 22
RAW_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(77)) * BASE)
LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the string of ``gram`` bytes from each place on."""
    total, covered = RAW_CODE[data], 1
    whole, done, factor = None, 0, BASE
    left = gram
    while left:
        if left & 1:
            whole = total if whole is None else (
                whole[:len(data) - done - covered + 1] * factor
                + total[done:done + len(data) - done - covered + 1])
            done += covered
        left >>= 1
        if left:
            total = total[:-covered] * mix(np.full(1, covered, np.uint64)) + total[covered:]
            covered *= 2
    return mix(whole)


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM
            ) -> tuple[np.ndarray, ...]:
    """(row, anchor, first and last passage start, gram hash); passages stay within a text."""
    n, width = len(data), least - gram + 1
    empty = np.zeros(0, np.int64)
    if n < least:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    lowest = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        covered += step
    ends = np.repeat(offsets[1:], np.diff(offsets))
    start = np.arange(n - least + 1)
    start = start[start + least <= ends[:n - least + 1]]
    at = (lowest[start] & LOW).astype(np.int64)
    if not len(start):
        return empty, empty, empty, empty, empty.astype(np.uint64)
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    tail = np.r_[head[1:], len(start)] - 1
    first, last, at = start[head], start[tail], at[head]
    return np.searchsorted(offsets, first, "right") - 1, at, first, last, hashes[at]


def _grams(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # copies within a batch: one stands for all
            keys = np.stack([batch.column(0).to_numpy(), pc.binary_length(batch.column(1))], axis=1)
            batch = batch.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))
            for first, data, offsets in chunks(batch.column(1)):
                row, at, _, _, hashes = anchors(data, offsets, least, gram)
                yield pa.record_batch([
                    pa.array(hashes.view(np.int64)),
                    batch.column(0).take(pa.array(first + row)),
                    pa.array((at - offsets[row]).astype(np.int32))], names=["h", "tkey", "at"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, tkey, at), those that share h with another one, or lie at an edge.

    Equal rows are the anchor of copies of one text: they count once.
    """
    edge = before = held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        new = np.r_[before is None or bool((rows[0] != before).any()),
                    (rows[1:] != rows[:-1]).any(axis=1)]
        last = rows[-1]
        rows = rows[new]
        if not len(rows):
            continue
        h = rows[:, 0]
        edge = h[0] if edge is None else edge
        same = h[1:] == h[:-1]
        kept = np.r_[False, same] | np.r_[same, False] | (h == edge)
        if before is not None and h[0] == before[0]:
            kept[0] = True
            if held is not None:
                yield held
        out = pa.record_batch([pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))],
                              names=["tkey", "at"])
        held = None if kept[-1] else out.slice(len(rows) - 1)
        before = last
        yield out.filter(pa.array(kept))
    if held is not None:
        yield held


def _suffixes(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            for first, data, offsets in chunks(batch.column(2)):
                n = len(offsets) - 1
                row, at, begin, end, _ = anchors(data, offsets, least, gram)
                part = wanted.slice(first, n)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False)
                asked = (np.repeat(offsets[:-1], sizes)
                         + part.flatten().to_numpy(zero_copy_only=False))
                marked = np.zeros(len(data) + 1, bool)
                marked[asked[(asked >= 0) & (asked < len(data))]] = True
                kept = marked[at]
                row, at, begin, end = row[kept], at[kept], begin[kept], end[kept]
                where = np.r_[0, np.cumsum(end - begin + least)]
                low = 0
                while low < len(at):  # a suffix can be a hundred times as long as its step
                    high = max(low + 1, int(np.searchsorted(where, where[low] + OUTPUT, "right")) - 1)
                    some = slice(low, high)
                    place = where[low:high + 1] - where[low]
                    source = np.repeat(begin[some] - place[:-1], np.diff(place)) + np.arange(place[-1])
                    lead = data[at[some, None] + np.arange(LEAD)]
                    ids = pa.array(first + row[some])
                    yield pa.record_batch([
                        _strings(lead.reshape(-1), np.arange(high - low + 1) * LEAD),
                        batch.column(0).take(ids), batch.column(1).take(ids),
                        pa.array((begin[some] - offsets[row[some]]).astype(np.int64)),
                        _strings(data[source], place)],
                        names=["lead", "id", "tkey", "start", "bytes"])
                    low = high

    return run


def _strings(flat: np.ndarray, where: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(where) - 1, [
        None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def multikey_sort(words: np.ndarray, place: np.ndarray, depths: list[int]
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(members, run) of the equal strings that start at ``place``, run by run.

    ``words`` has the eight bytes from each byte on as a number.  Strings are sorted by one word
    after the other; only those that tie so far go on.
    """
    members, run = np.arange(len(place)), np.zeros(len(place), np.int64)
    for depth in depths:
        if not len(members):
            break
        key = words[place[members] + depth]
        if depth == depths[0]:
            order = np.argsort(key)
            members, key = members[order], key[order]
        else:  # runs whose strings all have the same word are in order as they are
            differs = (key[1:] != key[:-1]) & (run[1:] == run[:-1])
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][differs]] = True
            some = np.flatnonzero(mixed[run])
            order = some[np.lexsort((key[some], run[some]))]
            members[some], key[some] = members[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (run[1:] != run[:-1])]
        run = np.cumsum(new) - 1
        tied = np.bincount(run)[run] > 1
        members, run = members[tied], run[tied]
    return members, run


def _bucket(least: int):
    depths = [*range(0, least - 7, 8)] + ([least - 8] if least % 8 else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(4)).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                done = int(ends[low - 1]) if low else 0
                high = int(np.searchsorted(ends, done + RANGE_BYTES - size, "right"))
                high = min(max(high, low + (not held)), low + RANGE - rows, batch.num_rows)
                if high > low:
                    held.append(batch.slice(low, high - low))
                    rows, size, low = rows + high - low, size + int(ends[high - 1]) - done, high
                if low < batch.num_rows:
                    yield from sort(held)
                    held, rows, size = [], 0, 0
        if held:
            yield from sort(held)

    def sort(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        lead, ids, keys, start, strings = (c.chunk(0) for c in table.columns)
        flat = np.frombuffer(strings.buffers()[2], np.uint8)
        where = np.frombuffer(strings.buffers()[1], np.int32).astype(np.int64)[
            strings.offset:strings.offset + len(strings) + 1]
        words = flat.astype(np.uint64)
        for k in (1, 2, 4):
            words = (words[:-k] << np.uint64(8 * k)) | words[k:]
        keys, start = keys.to_numpy(), start.to_numpy()
        null = np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy()
        count = np.diff(where) - least + 1
        row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place, begin = where[row] + nth, start[row] + nth
        members, same = multikey_sort(words, place, depths)
        r = row[members]
        order = np.lexsort((begin[members], keys[r], number[r], ~null[r], same))
        members, same = members[order], same[order]
        repeat = np.zeros(len(row), bool)
        if len(members):
            repeat[members[1:][same[1:] == same[:-1]]] = True
        # passages whose equals may lie in another range: the earliest ones go on
        first = np.frombuffer(lead.buffers()[2], np.uint8)[
            lead.offset * LEAD:(lead.offset + len(lead)) * LEAD].reshape(-1, LEAD)
        one, two = (np.ascontiguousarray(first[:, k:k + 8]).view(">u8")[:, 0] for k in (0, 8))
        rank = np.lexsort((two, one))
        edge = np.zeros(len(lead), bool)
        for e in (rank[0], rank[-1]):
            edge |= (one == one[e]) & (two == two[e])
        going = np.flatnonzero(edge[row] & ~repeat)
        digest = np.zeros((len(going), 2), np.uint64)
        for k in (0, 1):
            for depth in depths:
                digest[:, k] = mix(digest[:, k] + np.full(1, k + 1, np.uint64)) + words[
                    place[going] + depth]
        head = np.flatnonzero(repeat & ~np.r_[False, repeat[:-1] & (row[1:] == row[:-1])])
        tail = np.flatnonzero(repeat & ~np.r_[repeat[1:] & (row[1:] == row[:-1]), False])
        codes = _strings(np.ascontiguousarray(mix(digest)).view(np.uint8).reshape(-1),
                         np.arange(len(going) + 1) * 16)
        for who, low, high, code in (
                (row[head], begin[head], begin[tail] + least, pa.nulls(len(head), pa.binary())),
                (row[going], begin[going], begin[going] + least, codes)):
            for at in range(0, len(who), 100_000):
                some = slice(at, at + 100_000)
                yield pa.record_batch([
                    ids.take(pa.array(who[some])), pa.array(keys[who[some]]),
                    pa.array(low[some]), pa.array(high[some]),
                    code.slice(at, len(who[some]))],
                    names=["id", "tkey", "start", "end", "digest"])

    return run


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs, and what is left."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if runs and low <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], high)
        else:
            runs.append((low, high))
    places = [0, *(x for r in runs for x in r), len(text)]
    return runs, b"".join(text[a:b] for a, b in zip(places[::2], places[1::2]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, high = batch.column(3), batch.column(4)
        out = []
        for i, text in enumerate(batch.column(2)):
            runs, left = kept_bytes(text.as_py().encode(), list(zip(low[i].as_py(),
                                                                   high[i].as_py())))
            out.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest()))
        columns = list(zip(*out)) or [[]] * 3
        yield pa.record_batch([batch.column(0), batch.column(1),
                               *(pa.array(c, t) for c, t in zip(columns, (
                                   pa.int64(), pa.int64(), pa.string())))],
                              names=["id", "tkey", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    A byte is removed if it lies in a string of ``least`` bytes that also starts earlier: in a
    smaller key (null is smallest), or before in the same text.  Rows of equal key and equal text
    are one document and get equal results; different texts of one key stand in the order of a
    hash.  Null texts are empty; texts shorter than ``least`` lose nothing.  Keys are integers.
    Other columns are ignored.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("tkey", F.xxhash64("text"))
    base = written(source.select("id", "tkey", F.octet_length("text").cast("bigint")
                                 .alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "tkey")
    owner = base.groupBy("sha").agg(F.min(order).alias("first"))

    grams = source.select("tkey", "text").mapInArrow(_grams(least, gram),
                                                     "h bigint, tkey bigint, at int")
    flagged = written(grams.repartitionByRange("h", "tkey").sortWithinPartitions("h", "tkey", "at")
                      .mapInArrow(_repeated, "tkey bigint, at int"), "repeated-grams")
    places = flagged.groupBy("tkey").agg(F.collect_set("at").alias("at"))
    # the earliest of equal texts stands for all of them; texts that share a hash share places,
    # of which those of the other one only cost a look
    earliest = owner.select(F.col("first.id").alias("i2"), F.col("first.tkey").alias("t2"))
    places = places.join(earliest, F.col("tkey") == F.col("t2")).select("i2", "t2", "at")
    both = F.col("id").eqNullSafe(F.col("i2")) & (F.col("tkey") == F.col("t2"))
    texts = source.hint("merge").join(places, both).select("id", "tkey", "text", "at")
    texts = written(texts, "texts-with-repeats")
    release(flagged)
    suffixes = texts.mapInArrow(
        _suffixes(least, gram), "lead binary, id bigint, tkey bigint, start bigint, bytes binary")
    found = written(suffixes.repartitionByRange("lead", "id", "start")
                    .sortWithinPartitions("lead", "id", "start").mapInArrow(_bucket(least),
                                "id bigint, tkey bigint, start bigint, end bigint, digest binary"),
                    "suffix-ranges")
    going = found.where(F.col("digest").isNotNull())
    across = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_first(), "tkey", "start")
    spans = found.where(F.col("digest").isNull()).drop("digest").unionByName(
        going.withColumn("nth", F.row_number().over(across)).where(F.col("nth") > 1)
        .drop("nth", "digest"))
    spans = spans.groupBy("id", "tkey").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("id").alias("i2"), F.col("tkey").alias("t2"),
                         F.col("spans.start").alias("low"), F.col("spans.end").alias("high"))
    cut = texts.drop("at").dropDuplicates(["id", "tkey"]).hint("merge").join(spans, both).select(
        "id", "tkey", "text", "low", "high").mapInArrow(
        _cut, "id bigint, tkey bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    cut = written(cut.withColumnsRenamed({"id": "i2", "tkey": "t2"}), "cut-texts")
    release(texts, found)

    copies = base.join(owner, "sha").withColumn(
        "copy", (F.struct(F.col("id").isNotNull().alias("known"), "id", "tkey") != F.col("first"))
        & (F.col("n_bytes") >= least))
    rows = copies.join(cut, both, "left")
    gone = F.col("copy")
    return rows.select(
        F.col("id").alias(key), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0)))
        .cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha"))
        .alias("kept_sha256"))
