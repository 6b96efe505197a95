"""Personal data by patterns, and the terms that give it away by corpus statistics.

Patterns find the protected entities: addresses, card and phone numbers.  A term anywhere in a text
with an entity e reveals it as far as the corpus lets e be inferred from the term t.  The chance q of
e given t is estimated from the *other* texts with t, since the text in which a pair was noticed is no
evidence for it: q = (n_both - 1 + w r) / (n_term - 1 + w).  A term seen once thus has the rate r of
its class: the rate at which terms that are near an entity, or far from it, occur with the same entity
again, which is counted over the corpus and itself drawn towards zero.  With p the share of texts with
e, the term is expected to tell q log(q / p) of the information -log p; a term that tells more than a
share of it is generalised, one that tells nearly all is removed.  What an entity has in common with
others (mail domain, network, leading digits) is an entity too, that tells a part of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohort.llm.textbytes import chunks, mix, word_bounds, word_hashes
from cohort.llm.columns import unused
from cohort.session import release, written, written_alone

KINDS = ("email", "ip", "card", "phone", "general", "term")
#: Words on each side of an entity that count as near, and the shares of the entity's information
#: from which a term is generalised or removed.
REACH, GENERALISE, REMOVE = 5, 0.4, 0.7
#: Texts that the rate of its class counts for in the estimate of a term, texts without the entity
#: that are added to those of a class, and the weight of what a term tells that is near in no text.
WEIGHT, DOUBT, FAR = 2.0, 20.0, 0.9
#: Words of a run; texts with the same smallest hash of a run count as near copies.
RUN = 5
#: Rows of places that are held before they are passed on.
HELD = 1 << 17
#: Hash buckets that tell which texts may have copies, a broadcast of one line each at most.
BUCKETS = 1 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DIGITS = re.compile(r"[0-9]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of LOCAL+ @ DOMAIN, leftmost first; each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in code points."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def near_words(text: str, start: int, end: int, reach: int) -> list[tuple[int, int]]:
    """Up to ``reach`` words with a letter on each side of a span."""
    words, room = [], 200
    while True:
        low = max(0, start - room)
        words = [(m.start(), m.end()) for m in WORD.finditer(text, low, start)]
        if low and words and words[0][0] == low:
            words = words[1:]  # may be cut
        if low == 0 or len(words) >= reach:
            break
        room *= 4
    words = words[-reach:]
    for m in WORD.finditer(text, end):
        words.append((m.start(), m.end()))
        if m.end() and len(words) >= 2 * reach:
            break
    return [(a, b) for a, b in words if any(c.isalpha() for c in text[a:b])]


def term_places(text: str, spans: list[tuple[int, int, int]], reach: int
                ) -> dict[str, tuple[bool, list[int], list[int]]]:
    """For each word with a letter: is it near a span, and its starts and ends outside of spans."""
    near = {x for a, _, b in spans for x, _ in near_words(text, a, b, reach)}
    places: dict[str, tuple[bool, list[int], list[int]]] = {}
    at, done = 0, 0
    for m in WORD.finditer(text.translate(LOWER)):
        x, y = m.span()
        while at < len(spans) and spans[at][0] < y:
            done = max(done, spans[at][2])
            at += 1
        if x < done or not any(c.isalpha() for c in m[0]):
            continue
        close, starts, ends = places.get(m[0], (False, [], []))
        places[m[0]] = close or x in near, starts, ends
        starts.append(x)
        ends.append(y)
    return places


def entity_codes(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """Codes of an entity and of what it shares with others: domain, network, leading digits."""
    value = text[start:end].lower()
    if kind == 0:
        shared = value.partition("@")[2]
    elif kind == 1:
        shared = ".".join(value.split(".")[:2])
    else:
        value = "".join(DIGITS.findall(value))
        shared = value[:6]
    return tuple(int.from_bytes(hashlib.blake2b(
        x.encode(), digest_size=8).digest(), "big", signed=True)
        for x in (f"{kind}{value}", f"{kind}in{shared}"))


def look(text: str) -> int:
    """The smallest hash of a run of ``RUN`` words, which near copies mostly share."""
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end, _ = word_bounds(data, np.array([0, len(data)]))
    words = word_hashes(data, begin, end)
    runs = words[:max(len(words) - RUN + 1, 1)].copy()
    for k in range(1, min(RUN, len(words))):
        runs = mix(runs) + words[k:k + len(runs)]
    return int(mix(runs).min().view(np.int64)) if len(runs) else 0


def _find(reach: int):
    def row(kind, **columns):
        n = len(next(iter(columns.values())))
        return pa.record_batch(
            [pa.array(np.full(n, kind, np.int32))]
            + [columns.get(f.name, pa.nulls(n, f.type)) for f in SCHEMA], names=[
                "what", *SCHEMA.names])

    def table(kind, names, tuples):
        return row(kind, **{n: pa.array(values, SCHEMA.field(n).type)
                            for n, values in zip(names, zip(*tuples))})

    def terms(near):
        data = np.frombuffer("\n".join(x[1] for x in near).encode(), np.uint8)
        begin, end, _ = word_bounds(data, np.array([0, len(data)]))
        codes = word_hashes(data, begin, end).view(np.int64).tolist()
        return table(1, ("tkey", "term", "near", "starts", "ends"),
                     [(x[0], code, *x[2:]) for x, code in zip(near, codes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.uint64)
        for batch in batches:
            found, near, entities = [], [], []
            for tkey, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                spans = base_spans(text)
                if not spans:
                    continue
                kinds = [k for _, k, _ in spans]
                found.append((tkey, *(kinds.count(k) for k in range(4)),
                              [a for a, _, _ in spans], kinds, [b for _, _, b in spans]))
                codes = {entity_codes(text, *s) for s in spans}
                alike = look(text)
                entities += [(tkey, e, part, alike) for part in (False, True)
                             for e in {c[part] for c in codes}]
                near += [(tkey, word, *places)
                         for word, places in term_places(text, spans, reach).items()]
                if len(near) > HELD:
                    yield terms(near)
                    near = []
            if found:
                yield table(0, ("tkey", "n_email", "n_ip", "n_card", "n_phone", "starts", "kinds",
                                "ends"), found)
                yield table(3, ("tkey", "entity", "near", "n"), entities)
            if near:
                yield terms(near)
            # in how many texts each word stands, added up as far as memory allows
            for _, data, offsets in chunks(batch.column(1)):
                begin, end, rows = word_bounds(data, offsets)
                words = word_hashes(data, begin, end)
                order = np.lexsort((rows, words))
                words, rows = words[order], rows[order]
                new = np.r_[True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])]
                words, counts = np.unique(words[new[:len(words)]], return_counts=True)
                held = np.concatenate([held, np.stack([words, counts.astype(np.uint64)], axis=1)])
                if len(held) > 1 << 20:
                    held = _added(held)
                if len(held) > 1 << 19:
                    yield row(2, term=pa.array(held[:, 0].copy().view(np.int64)),
                              n=pa.array(held[:, 1].astype(np.int64)))
                    held = held[:0]
        held = _added(held)
        if len(held):
            yield row(2, term=pa.array(held[:, 0].copy().view(np.int64)),
                      n=pa.array(held[:, 1].astype(np.int64)))

    return run


def _added(held: np.ndarray) -> np.ndarray:
    if not len(held):
        return held
    words, index = np.unique(held[:, 0], return_inverse=True)
    return np.stack([words, np.bincount(index, held[:, 1].astype(np.float64)).astype(np.uint64)],
                    axis=1)


SCHEMA = pa.schema([
    ("tkey", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()),
    ("n_phone", pa.int64()), ("starts", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int64())), ("entity", pa.int64()), ("term", pa.int64()),
    ("near", pa.bool_()), ("n", pa.int64())])
DDL = ("what int, tkey bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
       "starts array<bigint>, kinds array<int>, ends array<bigint>, entity bigint, term bigint, "
       "near boolean, n bigint")


def _distinct_texts(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tkey, text) of each distinct text, and the written table of their keys.

    Texts are only moved to be folded, and only those in the bucket of a text with copies.
    """
    copies = written(keyed.groupBy("tkey").agg(F.count("*").alias("n")), "text-copies")
    bucket = F.pmod("tkey", F.lit(BUCKETS)).alias("bucket")
    repeated = F.broadcast(copies.where("n > 1").select(bucket).distinct())
    texts = keyed.select("tkey", F.coalesce("text", F.lit("")).alias("text"), bucket)
    once = texts.join(repeated, "bucket", "left_anti")
    folded = texts.join(repeated, "bucket", "left_semi").dropDuplicates(["tkey"])
    return once.unionByName(folded).drop("bucket"), copies


def disclosing_terms(found: DataFrame, total: int, generalise: float, remove: float) -> DataFrame:
    """(tkey, more): places of the terms that disclose an entity of their text.

    Entities that stand in the same texts are one, so a text with many entities of its own is no
    more work than one with a single entity.  Near copies with an entity count once.
    """
    n = float(max(total, 1))
    held = found.where("what = 3").select("tkey", "entity", F.col("near").alias("part"),
                                          F.col("n").alias("look"))
    same = held.groupBy("entity", "part").agg(
        F.count_distinct("look").alias("n_entity"), F.count("*").alias("texts"),
        F.bit_xor("tkey").alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "tkey")).alias("y"))
    # a shared part is measured by the most that an entity can have
    info = F.when(F.col("part"), F.log(F.lit(n))).otherwise(F.log(n / F.col("n_entity")))
    code = F.xxhash64("part", "texts", "x", "y").alias("class")
    same = same.withColumn("info", info).where(F.log(n / F.col("n_entity")) > F.greatest(
        F.col("info") * generalise, F.lit(1e-9)))
    classes = written(held.join(same.select("entity", "part", "n_entity", "texts", "info", code),
                                ["entity", "part"])
                      .select("tkey", "class", "look", "n_entity", "texts", "info").distinct(),
                      "entity-classes")
    # no term tells more than its chance, which is at most that of the term in all texts of the
    # entity: terms of more texts cannot reach the share, whatever their pairs
    limit = ((F.col("n_entity") - 1 + WEIGHT) / generalise + 1 - WEIGHT + F.col("texts")
             - F.col("n_entity") + 1e-6)
    most = classes.agg(F.max(limit)).head()[0] or 0.0
    words = found.where("what = 1").select("tkey", "term", "near")
    terms = (found.where("what = 2").groupBy("term").agg(F.sum("n").alias("n_term"))
             .where(F.col("n_term") <= most))
    pairs = written(words.join(terms, "term").join(classes, "tkey")
                    .where(F.col("n_term") <= limit), "entity-terms")
    release(classes)
    counted = written(pairs.groupBy("class", "term", "n_term", "n_entity", "info").agg(
        F.count_distinct("look").alias("n_both"), F.count("*").alias("seen"),
        F.max("near").alias("near")).withColumn(
            "others", F.greatest(F.col("n_term") - F.col("seen"), F.lit(0)) + F.col("n_both") - 1),
        "entity-term-counts")
    rate = {row["near"]: row["again"] / (row["others"] + DOUBT)  # one line per class
            for row in counted.groupBy("near").agg(F.sum(F.col("n_both") - 1).alias("again"),
                                                   F.sum("others").alias("others")).collect()}
    base = F.when(F.col("near"), rate.get(True, 0.0)).otherwise(rate.get(False, 0.0))
    chance = (F.col("n_both") - 1 + WEIGHT * base) / (F.col("others") + WEIGHT)
    told = (chance * F.log(F.greatest(chance, F.lit(1e-300)) * n / F.col("n_entity"))
            / F.col("info") * F.when(F.col("near"), 1.0).otherwise(FAR) + 1e-9)
    disclosed = written(
        counted.withColumn("told", told).where(F.col("told") >= generalise)
        .select("class", "term", F.when(F.col("told") >= remove, KINDS.index("term"))
                .otherwise(KINDS.index("general")).alias("kind")), "disclosed")
    release(counted)
    # places are only looked up for terms that disclose, so they do not move with the pairs
    named = written(pairs.select("tkey", "class", "term").join(disclosed, ["class", "term"])
                   .groupBy("tkey", "term").agg(F.max("kind").alias("kind")), "disclosing-terms")
    release(pairs, disclosed)
    places = found.where("what = 1").select("tkey", "term", "starts", "ends").join(
        named, ["tkey", "term"]).select(
            "tkey", "kind", F.explode(F.arrays_zip("starts", "ends")).alias("at"))
    return (places.groupBy("tkey", F.col("at.starts").alias("start"), F.col("at.ends").alias("end"))
            .agg(F.max("kind").alias("kind")).groupBy("tkey")
            .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH,
                  generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, tkey, n_email, n_ip, n_card, n_phone, base, spans) for every row of ``docs``.

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points, sorted; kinds count
    from 0 in the order of ``KINDS``.  ``spans`` adds the terms that disclose an
    entity of their text, at every place where they stand outside of ``base``: those expected to
    tell the share ``generalise`` or ``remove`` of its information, by the distinct texts that hold
    both, anywhere in them; that share counts ``FAR`` times where the term is within ``reach``
    words of an entity in none of these texts.  Texts without the entity keep the term.  Null texts are empty, and empty texts have
    no spans.  Rows of equal text count as one text in all statistics and get equal results.
    Keys are integers.  Other columns are ignored.
    """
    keyed = docs.select(F.col(key).cast("bigint").alias("id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey"),
                        F.col(text).alias("text"))
    texts, copies = _distinct_texts(keyed)
    total = copies.count()
    found = written(texts.mapInArrow(_find(reach), DDL), "personal-data")
    release(copies)
    struct = "array<struct<start:bigint,kind:int,end:bigint>>"
    base = F.arrays_zip(F.col("starts").alias("start"), F.col("kinds").alias("kind"),
                        F.col("ends").alias("end")).cast(struct)
    none, counts = F.array().cast(struct), ("n_email", "n_ip", "n_card", "n_phone")
    more = disclosing_terms(found, total, generalise, remove)
    held = written(found.where("what = 0").select("tkey", *counts, base.alias("base")).join(
        more, "tkey", "left").select("tkey", *counts, "base", F.array_sort(F.concat(
            "base", F.coalesce(F.col("more").cast(struct), none))).alias("spans")), "text-spans")
    release(found)
    return keyed.select("id", "tkey").join(held, "tkey", "left").select(
        F.col("id").alias(key), "tkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitised(text: str, starts: list[int], kinds: list[int], ends: list[int]) -> str:
    """The text with entities and generalised terms named by kind, and removed terms left out."""
    out, done = [], 0
    for a, k, b in zip(starts, kinds, ends):
        if b <= done:
            continue
        out.append(text[done:max(a, done)])
        if a >= done:
            out.append("" if KINDS[k] == "term" else
                       "[word]" if KINDS[k] == "general" else f"[{KINDS[k]}]")
        done = b
    return "".join(out) + text[done:]


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = zip(*(c.to_pylist() for c in batch.columns[2:]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(
            [sanitised(*x) for x in lists], pa.string())], names=["i3", "t3", "clean"])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of the text.

    All columns and rows stay, whatever their names; null texts stay null.
    """
    found = written_alone(
        lambda: personal_data(docs, key, text, **settings).where(F.size("spans") > 0).select(
            F.col(key).alias("i2"), F.col("tkey").alias("t2"), "spans")
        .dropDuplicates(["i2", "t2"]), "spans")
    mine = docs.select(F.col(key).cast("bigint").alias("i1"), F.col(text).alias("t"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t1"))
    same = F.col("i1").eqNullSafe(F.col("i2")) & (F.col("t1") == F.col("t2"))
    changed = mine.hint("merge").join(found, same).select(
        "i2", "t2", "t", F.col("spans.start").alias("s"), F.col("spans.kind").alias("k"),
        F.col("spans.end").alias("e")).dropDuplicates(["i2", "t2"])
    i3, t3, clean = unused(docs, "i3", "t3", "clean")
    fixed = written(changed.mapInArrow(_rewrite, "i3 bigint, t3 bigint, clean string"),
                    "clean-texts").toDF(i3, t3, clean)
    release(found)
    tkey = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.hint("merge").join(
        fixed, F.col(key).cast("bigint").eqNullSafe(F.col(i3)) & (tkey == F.col(t3)), "left"
    ).withColumn(text, F.coalesce(clean, text)).drop(i3, t3, clean)
