"""Phrase collocations from sorted suffix pointers.

Every word is a pointer to the suffix that starts with it, cut after ``longest`` words or at the end
of its piece of text.

1. Words are counted, and the few opening phrases that hold a large part of all places are found.
2. Each task sorts the suffixes of a run of texts, folds equal ones into one line with a count, and
   sends the lines to the bucket of their language and two leading words.  Below an opening that
   would fill a bucket by itself, one more word decides, and so on.
3. A bucket sorts its suffixes by multikey three-way quicksort: pointers are parted by one word,
   the parts of equal words by the next, down to the greatest depth.  The size of an equal part is
   the count of its phrase; a part that is not frequent is abandoned with all below it.
4. Cuts, scores and contained phrases follow from the table of frequent phrases by joins: the parts
   of a frequent phrase are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohort.llm.textbytes import BASE, LOWER, chunks, mix, word_hashes
from cohort.session import written

LONGEST, LEAST, FACTOR, TOP = 5, 100, 1000, 2000
#: Bytes of text, and words of one sort, that a task handles at once.
CHUNK, BLOCK = 1 << 22, 1 << 20
#: Suffixes that a bucket aims at, and the part of all places that no bucket may exceed.
BUCKET, PARTS = 1 << 20, 2000
BLANK, BREAK = 1, 2
#: Class of each byte: part of a word, blank between words, or end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK


class Words:
    """The words of a run of texts: bytes with one blank after each, ids, and words left in the
    piece from each word on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = KIND[data] == 0
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        kept = inside[start] if len(start) else np.zeros(0, bool)
        start, end = start[kept], end[kept]
        self.row = np.searchsorted(offsets, start, "right") - 1
        piece = np.searchsorted(np.flatnonzero(KIND[data] == BREAK), start)
        n = len(start)
        new = np.r_[True, (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])][:n]
        head = np.flatnonzero(new)
        self.left = np.repeat(np.r_[head[1:], n], np.diff(np.r_[head, n])) - np.arange(n)
        size = end - start + 1
        self.where = np.r_[0, np.cumsum(size)]
        self.bytes = np.empty(self.where[-1], np.uint8)
        for low in range(0, n, BLOCK):
            some = slice(low, min(low + BLOCK, n))
            a, b = self.where[some.start], self.where[some.stop]
            source = np.repeat(start[some] - self.where[some], size[some]) + np.arange(a, b)
            source[self.where[some.start + 1:some.stop + 1] - a - 1] = 0
            self.bytes[a:b] = LOWER[data[source]]
        self.bytes[self.where[1:] - 1] = 0x20
        self.ids, self.names = word_ids(self.bytes, self.where)

    def suffixes(self, first: int, last: int, longest: int) -> np.ndarray:
        """(last - first, longest) word ids of the suffixes; -1 behind the end of a piece."""
        out = np.full((last - first, longest), -1, np.int32)
        for k in range(longest):
            has = np.flatnonzero(self.left[first:last] > k)
            out[has, k] = self.ids[first + has + k]
        return out


def word_ids(flat: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the words that lie one after the other, and the distinct words."""
    words = pa.Array.from_buffers(pa.large_binary(), len(where) - 1, [
        None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def multikey_parts(ids: np.ndarray, weight: np.ndarray, least: int, at_least: np.ndarray | int = 0
                   ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, members, start of each part, size, first row) of the equal parts, depth by depth.

    Pointers are parted by the word at one depth after the other.  Parts that weigh less than
    ``least`` are given once at most (if their rows ask for it by an ``at_least`` of that depth or
    more) and go no deeper; neither do suffixes that have ended.
    """
    members = np.arange(len(ids))
    part = np.zeros(len(ids), np.int64)
    asked = np.broadcast_to(np.asarray(at_least), len(ids))
    for depth in range(ids.shape[1]):
        alive = ids[members, depth] >= 0
        members, part = members[alive], part[alive]
        if not len(members):
            return
        key = ids[members, depth].astype(np.int64)
        order = np.argsort((part << 32) | key, kind="stable")
        members, part, key = members[order], part[order], key[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        start = np.flatnonzero(new)
        size = np.add.reduceat(weight[members], start)
        yield depth + 1, members, start, size, members[start]
        part = np.cumsum(new) - 1
        going = (size >= least) | (np.maximum.reduceat(asked[members], start) > depth + 1)
        kept = going[part]
        members, part = members[kept], part[kept]


def _langs(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _counted(longest: int, parts: int):
    """Words with their counts (depth 1), and openings that hold a large part of a run of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, names = _langs(batch.column(0))
            for first, data, offsets in chunks(batch.column(1), CHUNK):
                words = Words(data, offsets)
                if not len(words.ids):
                    continue
                spoken = lang[first + words.row].astype(np.int64)
                both = spoken * len(words.names) + words.ids
                codes, count = np.unique(both, return_counts=True)
                yield _phrases(names, codes // len(words.names),
                               words.names.take(pa.array(codes % len(words.names))), 1, count)
                many = max(2, len(both) // parts)
                for low in range(0, len(both), BLOCK):
                    high = min(low + BLOCK, len(both))
                    ids = np.hstack([spoken[low:high, None].astype(np.int32),
                                     words.suffixes(low, high, longest - 1)])
                    for depth, _, start, size, row in multikey_parts(
                            ids, np.ones(high - low, np.int64), many):
                        heavy = np.flatnonzero(size >= many) if depth > 2 else ()
                        if len(heavy):
                            at = low + row[heavy]
                            yield _phrases(names, spoken[at], _runs(words, at, depth - 1),
                                           depth - 1, size[heavy])

    return run


def _runs(words: Words, at: np.ndarray, depth: np.ndarray | int) -> pa.Array:
    """The bytes of ``depth`` words from each of the words ``at``."""
    return gathered(words.bytes, words.where[at], words.where[at + depth])


def gathered(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    where = np.r_[0, np.cumsum(size)]
    source = np.repeat(start - where[:-1], size) + np.arange(where[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(flat[source]))])


def _phrases(names: pa.Array, lang: np.ndarray, phrase: pa.Array, depth: int,
             count: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([
        names.take(pa.array(lang)), phrase.cast(pa.large_string()).cast(pa.string()),
        pa.array(np.full(len(count), depth, np.int32)), pa.array(count.astype(np.int64))],
        names=["lang", "phrase", "m", "n"])


def _routed(longest: int, buckets: int, openings: list[tuple[str, str]]):
    """Folded suffixes as compressed blocks, one for each language, bucket and depth of route."""
    known: dict[str, set[bytes]] = {}
    for name, phrase in openings:
        known.setdefault(name, set()).add(phrase.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, names = _langs(batch.column(0))
            for first, data, offsets in chunks(batch.column(1), CHUNK):
                words = Words(data, offsets)
                if not len(words.ids):
                    continue
                spoken = lang[first + words.row]
                where = np.r_[0, np.cumsum([len(w) for w in words.names.to_pylist()])]
                codes = word_hashes(np.frombuffer(b"".join(words.names.to_pylist()), np.uint8),
                                    where[:-1], where[1:])
                for low in range(0, len(words.ids), BLOCK):
                    yield from _blocks(words, low, min(low + BLOCK, len(words.ids)), spoken,
                                       names, codes)

    def _blocks(words: Words, low: int, high: int, spoken: np.ndarray, names: pa.Array,
                codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = low + np.flatnonzero(words.left[low:high] > 1)
        if not len(at):
            return
        lang = spoken[at]
        have = np.minimum(words.left[at], longest)
        # route by two words, and by one more below an opening that is known to be large
        depth = np.full(len(at), 2)
        if known:
            heads = set()
            for name in names.to_pylist():
                heads |= {p[:p.index(b" ") + 1] for p in known.get(name, ())}
            leading = np.isin(words.ids[at], [k for k, w in enumerate(words.names.to_pylist())
                                              if w in heads])
            for d in range(2, longest):
                some = np.flatnonzero(leading & (depth == d) & (have >= d))
                phrases = _runs(words, at[some], d).to_pylist()
                tongue = names.take(pa.array(lang[some])).to_pylist()
                deeper = [p in known.get(t, ()) for p, t in zip(phrases, tongue)]
                depth[some[np.array(deeper, bool)]] = d + 1
        route = np.zeros(len(at), np.uint64)
        for k in range(longest):
            some = np.flatnonzero((depth > k) & (have > k))
            route[some] = mix(route[some] * BASE + codes[words.ids[at[some] + k]])
        bucket = (route % np.uint64(buckets)).astype(np.int64)
        group = (lang.astype(np.int64) * buckets + bucket) * (longest + 1) + depth
        groups, number = np.unique(group, return_inverse=True)
        ids = np.full((len(at), longest + 1), -1, np.int32)
        ids[:, 0] = number
        for k in range(longest):
            has = np.flatnonzero(have > k)
            ids[has, k + 1] = words.ids[at[has] + k]
        order = np.lexsort(ids.T[::-1])
        ids = ids[order]
        head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        count = np.diff(np.r_[head, len(ids)]).astype(np.uint32)
        at, have, number = at[order][head], have[order][head], ids[head, 0]
        text = _runs(words, at, have)
        place = np.frombuffer(text.buffers()[1], np.int64)
        flat = np.frombuffer(text.buffers()[2], np.uint8)
        edge = np.searchsorted(number, np.arange(len(groups) + 1))
        blocks = []
        for a, b in zip(edge[:-1], edge[1:]):
            raw = (np.uint32(b - a).tobytes() + have[a:b].astype(np.uint8).tobytes()
                   + count[a:b].tobytes() + flat[place[a]:place[b]].tobytes())
            blocks.append(np.int64(len(raw)).tobytes()
                          + pa.compress(raw, codec="zstd", asbytes=True))
        code = groups // (longest + 1)
        yield pa.record_batch([
            names.take(pa.array(code // buckets)), pa.array((code % buckets).astype(np.int32)),
            pa.array((groups % (longest + 1)).astype(np.int32)),
            pa.array(blocks, pa.binary())], names=["lang", "bucket", "depth", "block"])

    return run


def _sorted_bucket(longest: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        have, count, texts = [], [], []
        for block in table.column("block"):
            block = block.as_py()
            raw = pa.decompress(block[8:], int(np.frombuffer(block[:8], np.int64)[0]), "zstd",
                                asbytes=True)
            n = int(np.frombuffer(raw[:4], np.uint32)[0])
            have.append(np.frombuffer(raw, np.uint8, n, 4))
            count.append(np.frombuffer(raw, np.uint8, 4 * n, 4 + n).view(np.uint32))
            texts.append(raw[4 + 5 * n:])
        have, count = np.concatenate(have).astype(np.int64), np.concatenate(count)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        where = np.r_[0, np.flatnonzero(flat == 0x20) + 1]
        words, _ = word_ids(flat, where)
        first = np.cumsum(have) - have
        ids = np.full((len(have), longest), -1, np.int32)
        for k in range(longest):
            has = np.flatnonzero(have > k)
            ids[has, k] = words[first[has] + k]
        depth = int(table.column("depth")[0].as_py())
        out = []
        # openings above the depth of the route are in several buckets: their parts all count
        for m, _, _, size, row in multikey_parts(ids, count.astype(np.int64), least, depth):
            kept = np.flatnonzero((size >= least) | (m < depth)) if m > 1 else ()
            if len(kept):
                row, size = row[kept], size[kept]
                begin = where[first[row]]
                out.append((gathered(flat, begin, where[first[row] + m]), m, size))
        lang = table.column("lang").slice(0, 1).combine_chunks()
        lang = lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang
        parts = [_phrases(lang, np.zeros(len(n), np.int64), p, m, n) for p, m, n in out]
        empty = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int32()),
                           ("n", pa.int64())]).empty_table()
        return pa.Table.from_batches(parts) if parts else empty

    return run


_COUNTED = "lang string, phrase string, m int, n bigint"


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang",
                     longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) with f >= least, (lang, n)): phrases of m words, and all words."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = written(rows.mapInArrow(_counted(longest, PARTS), _COUNTED)
                      .groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n")), "word-counts")
    words = counted.where("m = 1")
    totals = written(words.groupBy("lang").agg(F.sum("n").cast("bigint").alias("n")), "word-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # an opening of this size in all is one in some run of texts: at most 6 * PARTS are found
    large = counted.where((F.col("m") > 1) & (F.col("n") >= max(BUCKET, total // PARTS) // 2))
    openings = [(r["lang"], r["phrase"]) for r in large.select("lang", "phrase").collect()]
    buckets = -(-total // BUCKET) or 1
    blocks = rows.mapInArrow(_routed(longest, buckets, openings),
                             "lang string, bucket int, depth int, block binary")
    sorted_ = blocks.groupBy("lang", "bucket", "depth").applyInArrow(
        _sorted_bucket(longest, least), _COUNTED)
    counts = sorted_.groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n"))
    phrases = words.unionByName(counts).where(F.col("n") >= least).select(
        "lang", F.expr("substring(phrase, 1, char_length(phrase) - 1)").alias("phrase"), "m",
        F.col("n").cast("bigint").alias("f"))
    return written(phrases, "frequent-phrases"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang",
                 longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    A phrase has 2 to ``longest`` words of one piece and occurs ``a >= least`` times; ``n`` is the
    number of words of its language.  Of the cuts into a first part (``l`` times) and the rest
    (``r`` times), the one of the lowest score floor(1000 * a * n / (l * r)) counts, the earliest of
    equal ones.  Phrases that a longer one of the same count contains are left out.  Ranks go by
    score, then count, both falling, then by the bytes of the phrase.

    Null languages are ``und``; null, empty and blank texts have no words.  Repeated rows count each
    time.  Keys and other columns are ignored.
    """
    phrases, totals = frequent_phrases(docs, text, lang, longest, least)
    words = F.split("phrase", " ", -1)
    longer = phrases.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"))
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.withColumn("w", words).select(
        "lang", "phrase", "m", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cut = cut.join(part.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
    cut = cut.join(part.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    cut = written(cut.join(totals, "lang"), "phrase-cuts")
    scored = cut.withColumn("score", F.expr(
        f"(cast(a * {FACTOR} as decimal(19, 0)) * cast(n as decimal(19, 0)))"
        " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # a phrase inside a longer one of its count is inside one of just one more word
    inside = cut.where("k = 1 AND a >= r").select("lang", F.col("rest").alias("phrase")).unionByName(
        cut.where("k = m - 1 AND a >= l").select("lang", F.col("first").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (best.join(inside.distinct(), ["lang", "phrase"], "left_anti")
            .select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
                    "n", "score"))
