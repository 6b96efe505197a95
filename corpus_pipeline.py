"""From raw documents to packed training sequences, one written table per stage.

Each stage works on all that the one before kept; all but the last return the columns of
documents.  Rows may repeat ids or texts, and any column may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.llm.bag_minhash import near_duplicates
from cohort.llm.columns import unused
from cohort.llm.crf_language import with_languages
from cohort.llm.packing import pack
from cohort.llm.sanitise import sanitise
from cohort.llm.winnowing import contamination
from cohort.session import written, written_alone

#: Share of the words that the language of a text has to label; acts with four languages or more.
LEAST_SHARE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with a letter; null and empty ones go.

    The score is the largest of K shares, at least 1 / K, so ``LEAST_SHARE`` rejects nothing with up
    to three known languages, and with four only scores below 0.3.  Texts in a language that was
    not learned, or of random letters, get a known label and pass.
    """
    (predicted,) = unused(docs, "predicted")
    rows = with_languages(docs, F.lit(False), name=predicted)
    label, score = F.col(f"{predicted}.lang_pred"), F.col(f"{predicted}.score")
    return rows.where((label != "und") & (score >= LEAST_SHARE)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of near copies.

    Texts without a word are alone; of rows that repeat id and text one stays.
    """
    one, two, first_of = unused(docs, "r1", "r2", "first_of")
    first = written_alone(lambda: near_duplicates(docs).where("first").select(
        F.col("row_key").alias(first_of)).distinct(), "firsts")
    keyed = docs.withColumns({one: F.xxhash64("doc_id", "text"),
                              two: F.xxhash64(F.lit(1), "text", "doc_id")}).hint("merge")
    # should two documents share one hash, the second tells them apart
    return keyed.join(first, F.col(one) == F.col(first_of)).dropDuplicates([one, two]).select(
        *docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a passage of the benchmark; null texts have none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key, tkey = unused(docs, "held_key", "held_text")
    held = written_alone(lambda: contamination(docs, items).where("n_hit > 0").select(
        F.col("doc_id").alias(key), F.col("tkey").alias(tkey)).distinct(), "held-documents")
    return docs.hint("merge").join(
        held, F.col("doc_id").eqNullSafe(F.col(key))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(tkey)), "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it; every document stays, also repeated
    rows, and null texts stay null."""
    return sanitise(docs).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(
        *docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: bin, capacity, used, the pieces of documents that each holds, and their
    doc_ids.

    Tokens are bytes, and an end mark after each document.  A piece has its offset in the sequence,
    doc_id, number, start in the document, length in tokens and bytes; the last piece of a document
    has one byte less than tokens.  Null and empty texts are an end mark only.  Rows that repeat id
    and text each have pieces of their own.
    """
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"),
                       F.sha2(F.concat_ws(":", F.col("doc_id").isNull().cast("string"), "doc_id",
                                          F.col("text").isNull().cast("string"), "text"), 256)
                       .alias("row_key"))
    pieces = pack(rows.select("row_key", (F.octet_length("bytes") + 1).alias("length")), "row_key")
    filled = pieces.join(rows.dropDuplicates(["row_key"]), "row_key").withColumn(
        "bytes", F.expr("substring(bytes, cast(start + 1 as int), cast(length as int))"))
    bins = filled.groupBy("bin", "capacity", "used").agg(F.sort_array(F.collect_list(
        F.struct("offset", "doc_id", "piece", "start", "length", "bytes"))).alias("pieces"))
    return bins.withColumn("doc_ids", F.col("pieces.doc_id"))


STAGES = [("language", known_language), ("near copies", without_near_copies),
          ("benchmarks", without_benchmarks), ("personal data", without_personal_data),
          ("packing", packed)]
#: The classifier of the first stage and the signatures of the second are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
