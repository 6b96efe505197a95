"""Benchmark passages in training text by winnowed fingerprints.

Only DataFrame functions.  Every run of ``window`` words contains ``window - gram + 1`` word
grams; the smallest of their hashes is its fingerprint.  Two texts that share a run of that many
words therefore share its fingerprint, so joining the fingerprint sets finds every document that
can hold a passage.  Fingerprint hits are then extended: only the runs that cover a hit are
compared with the runs of the benchmark.

Computed arrays are exploded by the outer form: for the inner one the optimizer would add a
filter on the array's size and compute the array twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohort.session import written

#: Bytes between words: ASCII other than digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case and other letters as they are; null has none."""
    text = F.coalesce(text, F.lit(""))
    lowered = (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))  # ASCII only
               .otherwise(F.translate(text, UPPER, LOWER)))
    return F.array_remove(F.split(lowered, GAP), "")


def _from(array: str | Column, nth: int) -> Column:
    """The array from its nth element on."""
    return F.slice(array, nth, 2 ** 30)


def _grams(df: DataFrame, length: int, name: str = "g") -> DataFrame:
    """Add the hash of each run of ``length`` word hashes in column h; no run, no hash.

    Runs of 2, 4, 8 ... words come from two runs of half the length, the rest word by word.
    """
    df, covered = df.withColumn(name, F.col("h")), 1
    while 2 * covered <= length:
        df = df.withColumn(name, F.zip_with(name, _from(name, covered + 1),
                                            lambda x, y: F.xxhash64(x, y)))
        covered *= 2
    grams = F.col(name)
    for k in range(covered, length):
        grams = F.zip_with(grams, _from("h", k + 1), lambda x, y: F.xxhash64(x, y))
    return df.withColumn(name, F.slice(grams, 1, F.greatest(F.size("h") - (length - 1),
                                                            F.lit(0))))


def _minima(df: DataFrame, width: int) -> DataFrame:
    """Replace the grams in column g by the smallest hash of each run of ``width`` of them."""
    df, covered = df.withColumn("least", F.col("g")), 1
    while covered < width:
        step = min(covered, width - covered)
        df = df.withColumn("least", F.zip_with("least", _from("least", step + 1),
                                               lambda x, y: F.least(x, y)))
        covered += step
    return df.withColumn("g", F.slice(
        "least", 1, F.greatest(F.size("g") - (width - 1), F.lit(0)))).drop("least")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Replace the text by the hashes of its words."""
    return (df.withColumn("w", words(F.col(text)))
            .withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).drop("w", text))


def _runs(df: DataFrame, length: int) -> DataFrame:
    """One row per run of ``length`` words: start and a 128-bit hash."""
    h = F.col("h")
    starts = F.when(F.size(h) >= length, F.sequence(F.lit(0), F.size(h) - length)).otherwise(
        F.array().cast("array<int>"))
    both = F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.xxhash64(F.lit("a"), F.slice(h, i + 1, length)).alias("a"),
        F.xxhash64(F.lit("b"), F.slice(h, i + 1, length)).alias("b")))
    return df.withColumn("r", F.explode_outer(both)).withColumn("m", F.lit(length))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5,
                  key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(key, tkey, n_words, n_hit, items) for every row of ``docs``.

    ``items`` lists, sorted as strings, the items of which a window occurs in the text; an item
    shorter than ``window`` words is one window.  ``tkey`` hashes the text, so documents that
    repeat a key keep their own results; equal rows get equal results.  Null and empty texts
    have no words, null item ids no entry in the list; items without words match nothing.
    Other columns are ignored.
    """
    width = window - gram + 1
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                         F.xxhash64(F.coalesce(text, F.lit(""))).alias("tkey"))
    bench = _hashed(items.select(F.col(item).alias("item"), F.col(item_text).alias("text")), "text")
    bench = written(bench.where(F.size("h") > 0), "bench-words")
    # lengths below the window: fewer than ``window`` numbers, whatever the benchmark
    short = [r[0] for r in bench.where(F.size("h") < window).select(F.size("h")).distinct()
             .collect()]
    full = bench.where(F.size("h") >= window)
    runs = _runs(full, window)
    for m in short:
        runs = runs.unionByName(_runs(bench.where(F.size("h") == m), m))
    runs = written(runs.select("item", "m", "r.a", "r.b").distinct(), "bench-runs")
    prints = _minima(_grams(full, gram), width).select(
        F.explode_outer("g").alias("print"))
    for m in short:
        prints = prints.unionByName(_grams(bench.where(F.size("h") == m), m).select(
            F.explode_outer("g").alias("print")))
    prints = written(prints.distinct(), "bench-prints")

    found = _hashed(source, "text").withColumn("n_words", F.size("h").cast("long"))
    found = _minima(_grams(found, gram), width)
    for m in short:
        found = _grams(found, m, f"g{m}")
    own = [F.array_distinct(g) for g in ("g", *(f"g{m}" for m in short))]
    found = written(found.select("key", "tkey", "n_words", F.concat(*own).alias("prints")),
                    "doc-prints")
    hits = written(found.select("key", "tkey", F.explode("prints").alias("print"))
                   .join(prints, "print", "left_semi").distinct(), "print-hits")

    # only texts with a hit are read again; of them, only the runs around a hit are compared
    k, same = F.col("key"), ["key", "tkey"]
    named = hits.select(k.alias("k2"), F.col("tkey").alias("t2")).distinct()
    # a merge join at every size: a plan that broadcasts small tables would move no text there
    again = source.hint("merge").join(named, k.eqNullSafe(F.col("k2")) & (F.col("tkey") == F.col("t2")),
                        "left_semi").dropDuplicates(same)
    again = written(_hashed(again, "text"), "hit-words")
    spots = []
    for m, length, first in [(window, gram, True), *((m, m, False) for m in short)]:
        at = _grams(again, length).select(
            *same, F.size("h").alias("n"), F.posexplode_outer("g").alias("pos", "print"))
        at = at.join(hits.withColumnsRenamed({"key": "k2", "tkey": "t2", "print": "p2"}),
                     F.col("key").eqNullSafe(F.col("k2")) & (F.col("tkey") == F.col("t2"))
                     & (F.col("print") == F.col("p2")), "left_semi")
        low = F.greatest(F.col("pos") - (width - 1), F.lit(0)) if first else F.col("pos")
        high = F.least("pos", F.col("n") - m)
        spots.append(at.where(low <= high).select(
            *same, F.explode(F.sequence(low, high)).alias("start"), F.lit(m).alias("m")))
    spots = _union(spots).distinct().groupBy(*same).agg(
        F.collect_list(F.struct("start", "m")).alias("spots"))
    spots = spots.withColumnsRenamed({"key": "k2", "tkey": "t2"})
    around = again.join(spots, F.col("key").eqNullSafe(F.col("k2"))
                        & (F.col("tkey") == F.col("t2")))
    h = F.col("h")
    cut = F.transform("spots", lambda s: F.struct(
        s["start"].alias("start"), s["m"].alias("m"),
        F.xxhash64(F.lit("a"), F.slice(h, s["start"] + 1, s["m"])).alias("a"),
        F.xxhash64(F.lit("b"), F.slice(h, s["start"] + 1, s["m"])).alias("b")))
    held = (around.select(*same, F.explode_outer(cut).alias("s")).select(*same, "s.*")
            .join(runs.select("m", "a", "b").distinct(), ["m", "a", "b"], "left_semi"))
    held = written(held, "held-runs")
    covered = held.groupBy(*same).agg(F.size(F.array_distinct(F.flatten(F.transform(
        F.collect_list(F.struct("start", "m")),
        lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1))))).cast("long").alias("n_hit"))
    of = (held.select(*same, "m", "a", "b").distinct().join(runs, ["m", "a", "b"])
          .groupBy(*same).agg(F.array_sort(F.collect_set(F.col("item").cast("string")))
                              .alias("items")))
    result = found.select("key", "tkey", "n_words")
    for extra, value in ((covered, "n_hit"), (of, "items")):
        extra = extra.withColumnsRenamed({"key": "k2", "tkey": "t2"})
        result = result.join(extra, F.col("key").eqNullSafe(F.col("k2"))
                             & (F.col("tkey") == F.col("t2")), "left").drop("k2", "t2")
    return result.select(
        F.col("key").alias(key), "tkey", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
