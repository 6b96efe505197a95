"""Near duplicates by BagMinHash: weighted-Jaccard signatures, banding, exact verification.

A document is the multiset of its runs of five words.  Every (run, block of weight levels) owns
a Poisson process over time whose rate is the width of the block; a point carries a register and
a level, and counts if the level lies within the run's weight.  The blocks double in width
(1, 1, 2, 4 ...), so a run of weight w needs about log w processes, not w.  A register keeps its
earliest point; two documents agree in a register with a probability equal to their weighted
Jaccard similarity.  A document stops drawing points once they come later than all its registers.

Documents with equal multisets are one node, found by a commutative digest.  Nodes that share a
band are candidates; links are only what an exact comparison of the multisets confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohort.llm.textbytes import BASE, CHUNK, chunks, mix, run_hashes, word_bounds, word_hashes
from cohort.operators.components import connected_components
from cohort.session import written

SHINGLE, BANDS, BAND_ROWS, THRESHOLD = 5, 20, 4, 0.8
#: Registers in all; those beyond the bands sharpen the estimate of similarity.
REGISTERS = 400
#: Rounds in which each node is compared with its likeliest partner only.
ROUNDS = 2
#: Members of a bucket that are compared as one block.
BLOCK = 1024
#: Points drawn in one go for all processes that are still running.
POINTS = 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct word runs, by row and hash."""
    start, end, rows = word_bounds(data, offsets)
    hashes, first = run_hashes(word_hashes(data, start, end), rows, length)
    rows = rows[first]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if not len(rows):
        return rows, hashes, np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])
    return rows[head], hashes[head], np.diff(np.r_[head, len(rows)])


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_rows: int, m: int
               ) -> np.ndarray:
    """(n_rows, m) codes of the earliest points; rows without runs keep the code of infinity."""
    earliest = np.full(n_rows * m, np.inf)
    # the blocks of levels: (0, 1], (1, 2], (2, 4], ... as far as the weight reaches into them
    row, state, low, width, weight = [], [], [], [], []
    block, bottom, wide = 0, 0, 1
    reached = np.arange(len(rows))
    while len(reached):
        row.append(rows[reached])
        state.append(mix(hashes[reached] + mix(np.full(1, block + 1, np.uint64))))
        low.append(np.full(len(reached), bottom, np.float64))
        width.append(np.full(len(reached), wide, np.float64))
        weight.append(counts[reached].astype(np.float64))
        block, bottom, wide = block + 1, bottom + wide, max(1, bottom + wide)
        reached = reached[counts[reached] > bottom]
    if not row:
        return mix(earliest.view(np.uint64)).reshape(n_rows, m)
    row, state, low, width, weight = map(np.concatenate, (row, state, low, width, weight))
    time = np.zeros(len(row))
    drawn = 0
    while len(row):
        each = max(1, POINTS // len(row))
        steps = np.arange(drawn + 1, drawn + each + 1, dtype=np.uint64) * BASE
        drawn += each
        bits = mix(state[:, None] + steps[None, :])
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
        # summed point by point, so a time does not depend on how many are drawn at once
        at = np.cumsum(np.c_[time, gap / width[:, None]], axis=1)[:, 1:]
        bits = mix(bits ^ BASE)
        register = ((bits >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        level = low[:, None] + np.floor(
            (bits & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32 * width[:, None]) + 1
        counted = level <= weight[:, None]
        slot = row[:, None] * m + register
        np.minimum.at(earliest, slot[counted], at[counted])
        latest = earliest.reshape(n_rows, m).max(axis=1)
        alive = at[:, -1] < latest[row]
        row, state, low, width, weight, time = (
            row[alive], state[alive], low[alive], width[alive], weight[alive], at[alive, -1])
    return mix(earliest.view(np.uint64)).reshape(n_rows, m)


def _digests(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_rows: int) -> np.ndarray:
    """128-bit digest of each multiset, whatever the order of its runs."""
    out = np.zeros((n_rows, 2), np.uint64)
    if len(rows):
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for k, salt in enumerate((np.uint64(1), np.uint64(2))):
            out[rows[head], k] = np.add.reduceat(
                mix(hashes ^ mix(counts.astype(np.uint64) * BASE + salt)), head)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Equal-length byte strings, one per row of an array."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    size = flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size),
        pa.py_buffer(flat.tobytes())])


def _sign(bands: int, band_rows: int, m: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(2)):
                n = len(offsets) - 1
                rows, hashes, counts = shingles(data, offsets)
                codes = signatures(rows, hashes, counts, n, m)
                number = np.arange(1, bands + 1, dtype=np.uint64) * BASE
                keys = np.zeros((n, bands), np.uint64) + number
                for k in range(band_rows):
                    keys = mix(keys + codes[:, k:bands * band_rows:band_rows])
                total = np.bincount(rows, counts, n).astype(np.int64)
                some = total > 0
                keys = keys.astype(np.uint64).view(np.int64)
                yield pa.record_batch([
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                    _fixed(_digests(rows, hashes, counts, n)), pa.array(total),
                    pa.ListArray.from_arrays(
                        np.r_[0, np.cumsum(some * bands)].astype(np.int32),
                        keys[some].reshape(-1)),
                    _fixed(np.concatenate([(codes & np.uint64(255)).astype(np.uint8),
                                           keys.view(np.uint8)], axis=1)),
                ], names=["key", "row_key", "node", "total", "bands", "sketch"])

    return run


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the word-run multisets of two columns, row by row."""
    n = len(left)
    parts = []
    for column in (left, right):
        whole = [shingles(data, offsets) for _, data, offsets in chunks(column, 1 << 40)]
        parts.append(whole[0] if whole else shingles(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    rows = np.concatenate([p[0] for p in parts])
    hashes = np.concatenate([p[1] for p in parts])
    counts = np.concatenate([p[2] for p in parts])
    order = np.lexsort((hashes, rows))
    rows, hashes, counts = rows[order], hashes[order], counts[order]
    both = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
    shared = np.bincount(rows[1:][both], np.minimum(counts[1:], counts[:-1])[both], n)
    joined = np.bincount(rows, counts, n) - shared
    return np.divide(shared, joined, out=np.zeros(n), where=joined > 0)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy() for k in (2, 3)]
            upto = np.cumsum(size[0].astype(np.int64) + size[1])
            first = 0
            while first < batch.num_rows:  # pairs of about CHUNK bytes, one at least
                start = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, start + CHUNK, "right")))
                part = batch.slice(first, last - first)
                first = last
                same = similarities(part.column(2), part.column(3)) >= threshold
                yield pa.record_batch([part.column(0), part.column(1), pa.array(same)],
                                      names=["a", "b", "linked"])

    return run


def _agreements(one: np.ndarray, two: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Equal registers of each pair of different components; 0 within a component.

    Most members of a block tend to be in one component, whose pairs are not looked at.
    """
    out = np.zeros((len(one), len(two)), np.int32)
    main = np.bincount(np.r_[na, nb]).argmax()
    for x, y in ((na != main, np.ones(len(nb), bool)), (na == main, nb != main)):
        x, y = np.flatnonzero(x), np.flatnonzero(y)
        for i in range(0, len(x), 16):
            some = x[i:i + 16]
            out[np.ix_(some, y)] = (one[some][:, None, :] == two[y][None, :, :]).sum(axis=2)
    out[na[:, None] == nb[None, :]] = 0
    return out


def _pairs_of_blocks(least: int, every: bool, bands: int):
    """Pairs of nodes in different components whose sketches agree in ``least`` registers or
    more: each node with its best partner in the other block, or every such pair.

    A sketch ends with the buckets of its node.  A pair counts only in the first bucket that it
    shares.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, one, ga, a, two, gb, b = (c[i].as_py() for c in batch.columns)
                rank = {g: k for k, g in enumerate({*ga, *gb})}
                if len(rank) == 1:
                    continue
                a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
                agree = _agreements(a[:, :-8 * bands], b[:, :-8 * bands],
                                    np.array([rank[g] for g in ga]),
                                    np.array([rank[g] for g in gb]))
                ka, kb = (np.ascontiguousarray(s[:, -8 * bands:]).view(np.int64) for s in (a, b))
                x, y = np.nonzero(agree >= least)
                for at in range(0, len(x), 1 << 16):
                    p, q = x[at:at + (1 << 16)], y[at:at + (1 << 16)]
                    first = (ka[p] == kb[q]).argmax(axis=1)
                    later = ka[p, first] != bucket
                    agree[p[later], q[later]] = 0
                if every:
                    x, y = np.nonzero(agree >= least)
                else:
                    x = np.r_[np.arange(len(one)), agree.argmax(axis=0)]
                    y = np.r_[agree.argmax(axis=1), np.arange(len(two))]
                    x, y = x[agree[x, y] >= least], y[agree[x, y] >= least]
                found = {(min(one[p], two[q]), max(one[p], two[q]), int(agree[p, q]))
                         for p, q in zip(x.tolist(), y.tolist())}
                if found:
                    columns = list(zip(*found))
                    yield pa.record_batch(
                        [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()),
                         pa.array(columns[2], pa.int32())], names=["a", "b", "agree"])

    return run


def _candidates(shared: DataFrame, sketches: DataFrame, found: DataFrame, least: int,
                every: bool, bands: int) -> DataFrame:
    """Pairs to compare in the buckets whose members are still in several components.

    A bucket is cut into blocks, and each pair of its blocks is looked at on its own.
    """
    placed = shared.join(found.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"),
                         "left").select("bucket", "node",
                                        F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count("*").alias("n")).where(F.col("low") != F.col("high")).select("bucket", "n")
    dealt = placed.join(mixed, "bucket").join(sketches, "node").withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = written(dealt.groupBy("bucket", "blocks", "block").agg(F.collect_list(
        F.struct("node", "component", "sketch")).alias("m")), "bucket-blocks")
    columns = ["m.node", "m.component", "m.sketch"]
    left = blocks.select("bucket", *columns, F.explode(F.sequence(
        F.col("block"), F.col("blocks") - 1)).alias("other"))
    right = blocks.select("bucket", F.col("block").alias("other"),
                          *(F.col(c).alias(c[2:] + "2") for c in columns))
    pairs = (left.join(right, ["bucket", "other"])
             .select("bucket", "node", "component", "sketch", "node2", "component2", "sketch2")
             .mapInArrow(_pairs_of_blocks(least, every, bands), "a binary, b binary, agree int"))
    if every:
        return written(pairs.select("a", "b").distinct(), "pairs")
    pairs = written(pairs.distinct(), "block-pairs")
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("to"), "agree"),
        F.struct(F.col("b").alias("node"), F.col("a").alias("to"), "agree"))).alias("e"))
    best = ends.select("e.*").groupBy("node").agg(
        F.max_by("to", F.struct("agree", F.hex("to"))).alias("to"))
    return written(best.select(F.least("node", "to").alias("a"),
                               F.greatest("node", "to").alias("b")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD, bands: int = BANDS,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """(key, row_key, class_id, n_copies, class_size, first) for every row of ``docs``.

    Documents are in one class if a chain of pairs of similarity ``threshold`` or more connects
    them.  ``class_id`` is the smallest key of the class, ``n_copies`` the number of rows with
    the same multiset of word runs.  ``row_key`` hashes key and text; ``first`` marks the rows of
    the smallest key and row key of each class, more than one only if whole rows repeat.  A text of fewer than five words is one run; texts without
    words (null and empty ones too) are alone.  Rows that repeat a key are members on their own.
    Other columns are ignored.

    A pair at the threshold shares no band with probability (1 - threshold ** band_rows) ** bands,
    3 in 100,000 at the defaults.  Each node is first compared with the node that leads most of
    its buckets, then, for some rounds, with the likeliest partner by signature outside its
    component.  So a group of n near copies grows together in a few times n comparisons.  Last,
    all pairs that share a bucket but not a component are compared, unless their signatures lie
    four standard deviations below the threshold (another 3 in 100,000).  No pair is left out.
    """
    source = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row_key"),
                         F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    signed = written(source.mapInArrow(
        _sign(bands, band_rows, REGISTERS),
        f"key {kind}, row_key bigint, node binary, total bigint, bands array<bigint>, sketch binary"), "signed")
    some = signed.where(F.col("total") > 0)
    nodes = written(some.groupBy("node").agg(
        F.min(F.struct("key", "row_key")).alias("lowest"), F.count("*").alias("n_copies")), "nodes")
    rows = (some.select("node", "bands").dropDuplicates(["node"])
            .select("node", F.explode_outer("bands").alias("bucket")))
    rows = written(rows, "buckets")
    leaders = (rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n"))
               .where(F.col("n") > 1).drop("n"))
    shared = written(rows.join(leaders, "bucket"), "shared-buckets")
    votes = shared.where(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(
        F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max_by(
        "leader", F.struct("votes", F.hex("leader"))).alias("leader"))
    pairs = written(best.select(F.col("leader").alias("a"), F.col("node").alias("b")), "pairs")
    texts = _texts(source, nodes, shared.select("node").distinct())
    sketches = written(some.join(shared.select("node").distinct(), "node", "left_semi")
                       .select("node", "sketch").dropDuplicates(["node"]), "sketches")
    links = _links(texts, pairs, threshold)
    least = int(REGISTERS * threshold - 4 * (REGISTERS * threshold * (1 - threshold)) ** 0.5)
    found = _joined(None, links)
    for every in [False] * ROUNDS + [True]:
        pairs = _candidates(shared, sketches, found, least, every, bands)
        found = _joined(found, _links(texts, pairs, threshold))

    classes = nodes.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    sizes = classes.groupBy("component").agg(F.min("lowest").alias("lowest"),
                                             F.sum("n_copies").alias("class_size"))
    classes = classes.drop("lowest").join(sizes, "component").select(
        "node", "lowest", "n_copies", "class_size")
    member = signed.select("key", "row_key",
                           F.when(F.col("total") > 0, F.col("node")).alias("node"))
    rows = member.join(classes, "node", "left")
    alone = F.col("lowest").isNull()
    return rows.select(
        F.col("key").alias(key), "row_key",
        F.when(alone, F.col("key")).otherwise(F.col("lowest.key")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("row_key") == F.col("lowest.row_key"))).alias("first"))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links; only components that the links join are looked at."""
    if found is None:
        return written(connected_components(links, "a", "b"), "components")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = written(found.unionByName(ends.join(found, "node", "left_anti").select(
        "node", F.col("node").alias("component"))), "components")
    edges = links
    for end in ("a", "b"):
        edges = edges.join(known.select(F.col("node").alias(end),
                                        F.col("component").alias(f"{end}2")), end)
    edges = written(edges.select("a2", "b2").where("a2 <> b2").distinct(), "joins")
    if edges.isEmpty():
        return known
    merged = connected_components(edges, "a2", "b2").select(
        F.col("node").alias("component"), F.col("component").alias("into"))
    return written(known.join(merged, "component", "left").select(
        "node", F.coalesce("into", "component").alias("component")), "components")


def _texts(source: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; each is looked up by its lowest row.

    Should two rows have one row key, only the text with the node's digest stays.
    """
    carriers = wanted.join(nodes, "node").select("node", F.col("lowest.row_key").alias("row_key"))
    # a merge join at every size: a plan that broadcasts small tables would move no text there
    texts = source.hint("merge").join(carriers, "row_key").select("node", "text")
    return written(texts.mapInArrow(_own, "node binary, text string").dropDuplicates(["node"]),
                   "pair-texts")


def _links(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs that an exact comparison confirms."""
    one = texts.withColumnsRenamed({"node": "a", "text": "text1"})
    two = texts.withColumnsRenamed({"node": "b", "text": "text2"})
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text1", "text2")
    checked = both.mapInArrow(_verify(threshold), "a binary, b binary, linked boolean")
    return written(checked.where("linked").select("a", "b"), "links")


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep texts whose multiset has the digest they were looked up for."""
    for batch in batches:
        for first, data, offsets in chunks(batch.column(1)):
            n = len(offsets) - 1
            digests = _digests(*shingles(data, offsets), n)
            part = batch.slice(first, n)
            wanted = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64).reshape(n, 2)
            yield part.filter(pa.array((wanted == digests).all(axis=1)))
