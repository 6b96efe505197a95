"""SimHash near duplicates by balls that meet in the middle.

A fingerprint has a bit for each of 64 places, set if more than half of the hashes of the text's
word shingles have it.  Fingerprints at distance 4 or less share a variant at distance 2 or less
from both, so each distinct fingerprint stands for all its variants within 2 flips (2,081) and
those that share one are linked.

Variants are dealt by the parities of a few groups of bit places.  Two flips change at most two
parities, so a fingerprint is sent once to each bucket that holds some of its variants (37 buckets
of 256 with eight groups) instead of once per variant, and the bucket makes the variants itself.
Parities depend on all bits, so a dense neighbourhood spreads over the buckets too.

All holders of a variant lie within 4 flips of one another: they are linked to the smallest of them,
never pair by pair.  Each such link is verified, a bucket keeps a spanning forest of its links, and
the links of all buckets are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohort.operators.components import connected_components
from cohort.operators.skew import join_groups
from cohort.session import written

WORDS, BITS, SEED, RADIUS = 4, 64, 42, 4
#: Bytes of one text that are split into words at once.
PIECE = 1 << 20
#: Variants that a bucket makes at once, and the mean that the number of groups aims at.
VARIANTS = 1 << 21
ONE = np.uint64(1)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes, cut at blanks."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The bits that more than half of the shingle hashes have; 0 if there is no word."""
    total, ones, last = 0, np.zeros(BITS, np.int64), []
    for piece in _pieces((text or "").encode().lower()):
        last = last + piece.split()
        if len(last) < words:
            continue
        line = b" ".join(last)
        ends = np.cumsum([len(w) + 1 for w in last])
        starts = [0, *ends[:-words].tolist()]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(line[a:b], SEED)
             for a, b in zip(starts, (ends[words - 1:] - 1).tolist())), np.uint64, len(starts))
        for some in np.array_split(hashes, -(-len(hashes) // 65536)):
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        last = last[len(last) - words + 1:]
    if not total and last:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)),
                                 np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))],
                                  names=["id", "print"])

    return run


def groups_of_places(count: int) -> list[np.ndarray]:
    """The 64 bit places in ``count`` groups of near-equal size."""
    return np.array_split(np.arange(BITS), count)


def mask(places: np.ndarray) -> int:
    return sum(1 << int(p) for p in places)


def flips(groups: list[np.ndarray]) -> dict[tuple[int, ...], np.ndarray]:
    """The flips of two places at most, by the groups whose parity they change."""
    bits = [[1 << int(p) for p in g] for g in groups]
    out = {(): [0] + [x | y for g in bits for i, x in enumerate(g) for y in g[:i]]}
    for a, one in enumerate(bits):
        out[a,] = one
        for b in range(a):
            out[b, a] = [x | y for x in one for y in bits[b]]
    return {k: np.array(v, np.uint64) for k, v in out.items()}


def parities(prints: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """One bit per group: whether an odd number of its places is set."""
    out = np.zeros(len(prints), np.uint64)
    for a, places in enumerate(groups):
        odd = np.bitwise_count(prints & np.uint64(mask(places))).astype(np.uint64) & ONE
        out |= odd << np.uint64(a)
    return out


def shared(prints: np.ndarray, bucket: int, groups: list[np.ndarray]
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, smallest holder) for the variants of this parity that several prints hold.

    A bucket of too many variants is split by finer groups, one part after the other.
    """
    table = flips(groups)
    away = parities(prints, groups) ^ np.uint64(bucket)
    kinds = {key: np.uint64(sum(1 << a for a in key)) for key in table}
    holders = {key: prints[away == kind] for key, kind in kinds.items()}
    size = sum(len(holders[key]) * len(table[key]) for key in table)
    if size > VARIANTS and len(groups) < BITS:
        finer = [half for g in groups for half in (np.array_split(g, 2) if len(g) > 1 else [g])]
        near = np.unique(np.concatenate(list(holders.values())))
        # each split group's parity is that of its halves: go through the halves' combinations
        for part in _combinations(groups, bucket):
            yield from shared(near, part, finer)
        return
    variants = np.concatenate([(holders[k][:, None] ^ table[k][None, :]).ravel() for k in table])
    source = np.concatenate([np.repeat(holders[k], len(table[k])) for k in table])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    at = np.searchsorted(twice, variants)
    at[at == len(twice)] = 0
    kept = twice[at] == variants
    at, source = at[kept], source[kept]
    order = np.lexsort((source, at))
    at, source = at[order], source[order]
    head = np.r_[True, at[1:] != at[:-1]]
    hub = source[np.flatnonzero(head)][np.cumsum(head) - 1]
    other = source != hub
    yield source[other], hub[other]


def _combinations(groups: list[np.ndarray], bucket: int) -> Iterator[int]:
    """The parities of the halves of all groups that give the parities ``bucket``."""
    parts, place = [0], 0
    for a, g in enumerate(groups):
        odd = bucket >> a & 1
        ways = [odd] if len(g) == 1 else [odd, odd ^ 3] if odd else [0, 3]
        parts = [p | w << place for p in parts for w in ways]
        place += 1 if len(g) == 1 else 2
    yield from parts


def forest(member: np.ndarray, hub: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links given, enough to connect what they connect."""
    pairs = np.unique(np.stack([member, hub], axis=1), axis=0).tolist()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return [a for a, _ in kept], [b for _, b in kept]


def _links(count: int, radius: int):
    groups = groups_of_places(count)

    def run(table: pa.Table) -> pa.Table:
        prints = np.sort(table.column("print").to_numpy().view(np.uint64))
        bucket = int(table.column("bucket")[0].as_py()) & (1 << BITS) - 1
        member, hub = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for a, b in shared(prints, bucket, groups):
            near = np.bitwise_count(a ^ b) <= radius
            pairs = forest(np.r_[member, a[near]], np.r_[hub, b[near]])
            member, hub = (np.array(p, np.uint64) for p in pairs)
        return pa.table({"a": pa.array(member.view(np.int64)), "b": pa.array(hub.view(np.int64))})

    return run


def links(prints: DataFrame, name: str = "print", radius: int = RADIUS,
          count: int | None = None) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``radius`` bits, 4 at most."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("balls of two flips prove distances up to 4")
    rows = prints.select(F.col(name).alias("print"))
    if count is None:  # each bucket then makes about VARIANTS variants
        count = max(2, min(BITS, (rows.count() * 2081 // VARIANTS).bit_length()))
    groups = groups_of_places(count)
    own = F.lit(0).cast("bigint")
    for a, places in enumerate(groups):
        value = mask(places)
        value -= (value >> 63) << 64
        odd = F.bit_count(F.col("print").bitwiseAND(F.lit(value).cast("bigint"))) % 2
        own = own.bitwiseOR(F.shiftleft(odd.cast("bigint"), a))
    near = [0] + [1 << a for a in range(count)] + [1 << a | 1 << b for a in range(count)
                                                   for b in range(a)]
    near = [x - (x >> 63 << 64) for x in near]
    sent = rows.withColumn("own", own).withColumn(
        "away", F.explode(F.array(*(F.lit(x).cast("bigint") for x in near))))
    return (sent.select(F.col("own").bitwiseXOR(F.col("away")).alias("bucket"), "print")
            .groupBy("bucket").applyInArrow(_links(count, radius), "a bigint, b bigint"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest key among the
    rows whose fingerprints can be reached by links of at most ``radius`` bits, null if none of
    them has a key.  Null texts are empty; texts without a word have the fingerprint zero and are
    linked like any other; rows may repeat keys and texts.  Other columns are ignored.
    """
    rows = written(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _fingerprints(words), f"id {docs.schema[key].dataType.simpleString()}, print bigint"),
        "fingerprints")
    groups = written(rows.groupBy("print").agg(F.min("id").alias("first"),
                                               F.count("*").alias("n")), "distinct-prints")
    found = written(links(groups, radius=radius).distinct(), "print-links")
    nodes = connected_components(found, "a", "b").select(
        F.col("node").alias("print"), F.col("component").alias("root"))
    placed = written(groups.join(nodes, "print", "left").withColumn(
        "root", F.coalesce("root", "print")), "placed-prints")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"),
                                          F.count("*").alias("parts"))
    placed = written(join_groups(placed, smallest, ["root"], "parts").select(
        "print", "n", "component_id"), "print-components")
    # no more than 2,000 fingerprints can hold a two-thousandth of the rows
    hot = max(1, rows.count() // 2000)
    return join_groups(rows, placed, ["print"], "n", hot).select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id")
